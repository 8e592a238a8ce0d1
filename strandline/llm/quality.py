"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic model of text statistics, fitted on a bounded sample of labelled rows, gives each
document its evidence: the log odds of its text against the base rate. Grouped sums of the
model's probabilities then give every host and every path of a host a Beta posterior. How
strongly a site is drawn to its parent is itself estimated from the spread between sites
(method of moments), so sparse paths shrink to their host and sparse hosts to all documents.
A document's posterior joins its own evidence with its path's mean, from which its own
probability has been taken out.

Only sums for each path and host are grouped, with partial sums in each task, so a host with a
third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, maybe_broadcast, written

#: Labelled rows to fit the document model on, at most.
MAX_LABELLED = 20_000
#: Documents below this posterior are rejected.
KEEP_FROM = 0.5
#: Path tables of at most so many rows are broadcast.
BROADCAST_PATHS = 100_000
FEATURES = 14
_PRIOR_ROWS = (1.0, 10_000.0)


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, each between 0 and about 3."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    upper, lower, digit = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    letters = upper + lower + n[128:].sum()
    stops = n[[33, 44, 46, 58, 59, 63]].sum()
    space = n[[9, 10, 13, 32]].sum()
    marks = size - letters - digit - stops - space
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(words)) / 4,
        upper / max(1, upper + lower),
        digit / size,
        min(1.0, 10 * marks / size),
        min(1.0, 10 * n[33] / size),
        min(1.0, 10 * n[124] / size),
        min(3.0, 10 * stops / size),
        len(set(words)) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        min(3.0, letters / k / 5),
        1 - len(set(lines)) / len(lines),
        float(len(words) < 5),
        float(sum(w.isupper() for w in words) > k / 2),
        min(1.0, len(lines) / k),
    ]


def evidence(text: Column, weights: np.ndarray) -> Column:
    """The log odds that the text is good, without sites."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([features(t) for t in texts.to_pylist()]).reshape(-1, FEATURES)
            yield pa.array(np.clip(design(rows) @ weights, -30, 30))

    return F.arrow_udf(run, "double")(text)


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x**2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the bias."""
    w = np.zeros(x.shape[1])
    base = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(base / (1 - base))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """weights of the document model, and the base rate of the labels."""

    weights: np.ndarray
    base: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model | None:
    """The document model, or None without labels of both kinds.

    Of more than ``max_labelled`` labelled rows, those with the smallest hashes of their ids
    count. Null labels and ids teach nothing; of several labels of one id the lowest holds.
    """
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.min(label).cast("double").alias("y"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
        .select(F.col(id_col).alias("l_id"), "y")
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    # at most max_labelled rows are broadcast, and as many short lists come to the driver
    rows = (
        docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id"))
        .select(F.xxhash64("l_id").alias("place"), "y", F.arrow_udf(run, "array<double>")(F.col("text")).alias("x"))
        .toPandas()
    )
    if rows.empty or rows["y"].nunique() < 2:
        return None
    rows = rows.sort_values(["place", "y"], kind="stable")
    x, y = np.array(rows["x"].tolist()), (rows["y"].to_numpy() >= 0.5).astype(float)
    return Model(logistic(design(x), y), float(y.mean()))


def _prior_rows(groups: DataFrame, parent: Column, rate: Column) -> float:
    """Strength of the parent's prior, in rows: what is left of the spread between groups once
    the spread expected from their sizes is taken off gives the Beta prior's precision."""
    row = groups.agg(
        F.sum(F.col("n") * (rate - parent) ** 2).alias("spread"),
        F.sum(parent * (1 - parent)).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("binomial"),
    ).first()
    if not row.n or not row.binomial:
        return _PRIOR_ROWS[1]
    between = (row.spread - row.noise) / row.binomial
    return float(np.clip(1 / between - 1 if between > 0 else np.inf, *_PRIOR_ROWS))


def posterior(
    docs: DataFrame, model: Model | None, host: Column, path: Column, text_col: str = "text", keep: list[str] | None = None, materialise: bool = False
) -> DataFrame:
    """``docs`` (their columns ``keep``; None: all) with evidence, host_mean, path_mean, posterior.

    ``host`` and ``path`` are columns of ``docs``; null is a host or path of its own.
    ``materialise`` writes the kept columns with the evidence once, instead of computing the
    features of the texts a second time.

    Defined cases: null and empty texts are judged as texts of no words; without a model the
    evidence is 0 and every posterior is 1, so that nothing is rejected; columns of ``docs``
    with the names of added ones are replaced.
    """
    added = ("evidence", "host_mean", "path_mean", "posterior")
    keep = [f"`{c}`" for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("evidence"), *[F.lit(1.0).alias(c) for c in added[1:]])
    h, p, q, s_h, s_p, sums = fresh(docs, "site h", "site p", "site q", "site s_h", "site s_p", "site sums")
    rows = docs.select(*keep, host.alias(h), path.alias(p), evidence(F.col(text_col), model.weights).alias("evidence"))
    if materialise:
        rows = written(rows, "quality-evidence")
    rows = rows.withColumn(q, 1 / (1 + F.exp(-F.col("evidence"))))
    paths = written(rows.groupBy(h, p).agg(F.sum(q).alias("s"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy(h).agg(F.sum("s").alias("h_s"), F.sum("n").alias("h_n"), F.count(F.lit(1)).alias("paths"))
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths")).first()
    mean = whole.s / whole.n if whole.n else model.base
    k_host = _prior_rows(hosts.select((F.col("h_s") / F.col("h_n")).alias("r"), F.col("h_n").alias("n")), F.lit(mean), F.col("r"))
    hosts = hosts.withColumn("h_mean", (F.col("h_s") + k_host * mean) / (F.col("h_n") + k_host)).select(F.col(h).alias("own_h"), "h_s", "h_n", "h_mean")
    paths = paths.join(hosts, F.col(h).eqNullSafe(F.col("own_h"))).drop("own_h")
    k_path = _prior_rows(paths.select((F.col("s") / F.col("n")).alias("r"), "n", "h_mean"), F.col("h_mean"), F.col("r"))
    site = F.struct("s", "n", "h_s", "h_n").alias(sums)
    sites = paths.select(F.col(h).alias(s_h), F.col(p).alias(s_p), site)
    joined = rows.join(maybe_broadcast(sites, whole.paths, BROADCAST_PATHS), F.col(h).eqNullSafe(F.col(s_h)) & F.col(p).eqNullSafe(F.col(s_p)))
    of = lambda c: F.col(sums)[c]
    host_mean = (of("h_s") - F.col(q) + k_host * mean) / (of("h_n") - 1 + k_host)
    path_mean = (of("s") - F.col(q) + k_path * F.col("host_mean")) / (of("n") - 1 + k_path)
    prior = float(np.log(model.base / (1 - model.base)))
    odds = F.col("evidence") - prior + F.log(F.col("path_mean") / (1 - F.col("path_mean")))
    return (
        joined.withColumn("host_mean", host_mean).withColumn("path_mean", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path_mean)))
        .select(*keep, "evidence", "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("posterior"))
    )


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, evidence, host_mean, path_mean, posterior and keep (boolean) of every document.

    By default the host is the document's source, and its path the language within it.

    Defined cases are those of :func:`fit` and :func:`posterior`: null and empty texts are texts of no
    words, null hosts and paths are sites of their own, repeated rows count each, other columns are
    not looked at, and without labels of both kinds every document is kept; an empty table gives
    no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scored = posterior(docs, fit(docs, labels), host, path, keep=["doc_id"], materialise=True)
    return scored.withColumn("keep", F.col("posterior") >= KEEP_FROM)


def drop_poor(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The documents that the classifier keeps, with their columns, whatever their names.

    Defined cases: as of :func:`classify`. The documents are written once with their evidence, so that
    the features of a text are computed once.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    names = ("evidence", "host_mean", "path_mean", "posterior")
    clash = [c for c in docs.columns if c.lower() in names]
    own = dict(zip(clash, fresh(docs, *[f"own {c}" for c in clash]), strict=True))
    safe = docs.withColumnsRenamed(own)
    scored = posterior(safe, fit(docs, labels), host, path, materialise=True).filter(F.col("posterior") >= KEEP_FROM)
    return scored.drop(*names).withColumnsRenamed({b: a for a, b in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
