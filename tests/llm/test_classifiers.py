import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality, toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "ve") for b in ("ra", "ne", "so", "pi") for c in ("", "n", "st")]


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus(n=500, seed=1):
    """Texts with quality and toxic labels; a third of all in one source."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        text = prose(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice([" ".join(w + "***" for w in text.split()), text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 40)])
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumblo" + rng.choice(["", "st", "ra", "n", "so"]))
            text = " ".join(words)
        docs.append((i, text, rng.choice(["en", "de"]), "s0" if i % 3 == 0 else f"s{rng.randint(1, 30)}"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(None, None, None, None), (1000, "", "en", "s1"), (1001, "word " * 50_000, "en", "s1"), (5, "twice", "en", "s2")]
    d = spark.createDataFrame([(*r, 7, 8.0) for r in docs], "doc_id long, text string, lang string, source string, n int, score double").repartition(4)
    return d, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), docs, dict((i, (q, t)) for i, q, t in labels)


def test_quality_separates_and_keeps_good_documents(tables):
    docs, labels, rows, truth = tables
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    keep = {r.doc_id: r.keep for r in got if r.doc_id != 5}
    wrong = sum(keep[i] != bool(q) for i, (q, _) in truth.items() if i != 5)
    assert wrong <= 0.02 * len(truth)
    assert all(0 <= r.posterior <= 1 and 0 < r.path_mean < 1 for r in got)


def test_quality_matches_a_plain_computation(tables):
    """Sites and posteriors against loops over rows."""
    docs, labels, rows, _ = tables
    model = quality.fit(docs, labels)
    got = {(r.doc_id, round(r.evidence, 6)): r for r in quality.posterior(docs, model, F.col("source"), F.col("lang"), keep=["doc_id"]).collect()}
    x = np.array([quality.features(t) for _, t, *_ in rows])
    odds = np.clip(quality.design(x) @ model.weights, -30, 30)
    p = 1 / (1 + np.exp(-odds))
    host, path = {}, {}
    for (_, _, lang, source), q in zip(rows, p, strict=True):
        host.setdefault(source, []).append(q)
        path.setdefault((source, lang), []).append(q)
    mean = p.mean()

    def strength(groups, parents):
        n = np.array([len(g) for g in groups])
        r = np.array([np.mean(g) for g in groups])
        m = np.array(parents)
        between = ((n * (r - m) ** 2).sum() - (m * (1 - m)).sum()) / (n * m * (1 - m)).sum()
        return float(np.clip(1 / between - 1 if between > 0 else np.inf, *quality._PRIOR_ROWS))

    k_host = strength(list(host.values()), [mean] * len(host))
    h_mean = {s: (sum(g) + k_host * mean) / (len(g) + k_host) for s, g in host.items()}
    k_path = strength(list(path.values()), [h_mean[s] for s, _ in path])
    for (i, _, lang, source), o, q in zip(rows, odds, p, strict=True):
        r = got[(i, round(float(o), 6))]
        hm = (sum(host[source]) - q + k_host * mean) / (len(host[source]) - 1 + k_host)
        pm = (sum(path[source, lang]) - q + k_path * hm) / (len(path[source, lang]) - 1 + k_path)
        assert r.host_mean == pytest.approx(hm, abs=1e-6) and r.path_mean == pytest.approx(min(max(pm, 1e-6), 1 - 1e-6), abs=1e-6)


def test_sparse_sites_shrink_more(spark):
    rows = [(i, "fine words here and there again" if i % 2 else "*** ### *** ###", "en", "big") for i in range(200)] + [(500, "*** ### *** ###", "en", "lone"), (501, "*** ### *** ###", "en", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert abs(got[500].host_mean - 0.5) <= 0.5 and got[0].host_mean == pytest.approx(0.5, abs=0.05)


def test_quality_without_labels_keeps_all(spark, tables):
    docs, labels, rows, _ = tables
    assert quality.drop_poor(docs, labels.limit(0)).count() == len(rows)
    assert quality.drop_poor(docs, labels.filter("quality = 1")).count() == len(rows)
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_drop_poor_returns_the_same_columns(tables):
    docs, labels, _, _ = tables
    clash = docs.withColumn("posterior", F.lit("mine")).withColumn("h", F.lit(1)).withColumn("s", F.lit(2))
    out = quality.drop_poor(clash, labels)
    assert out.columns == clash.columns and out.first().posterior == "mine"


def test_held_out_folds(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    got = {r.doc_id: r.h for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)} | {None: False}


def test_toxicity_on_held_out_rows(tables):
    docs, labels, rows, truth = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels, _, _ = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(a, b)


def test_model_is_the_same_for_any_partitioning_and_sparse(tables):
    docs, labels, _, _ = tables
    a, b = toxicity.train(docs.repartition(7), labels), toxicity.train(docs.coalesce(1), labels)
    assert np.allclose(a, b) and np.count_nonzero(a) < 5_000


def test_ftrl_by_the_book():
    """Against the textbook's loop over single coordinates."""
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 40, 8)), int(rng.random() < 0.5)) for _ in range(60)]
    at, w = toxicity.ftrl(rows, epochs=2)
    z, n, bias, bias_n = [0.0] * 41, [0.0] * 41, 0.0, 0.0
    ones = sum(y for _, y in rows)
    bias = np.log((ones + 0.5) / (len(rows) - ones + 0.5))

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for x, y in rows:
            ws = {int(i): weight(i) for i in x}
            g = 1 / (1 + np.exp(-(sum(ws.values()) + bias))) - y
            for i, v in ws.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * v
                n[i] += g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + bias_n**0.5)
    got = dict(zip(at.tolist(), w, strict=True))
    assert got.pop(1 << toxicity.BITS) == pytest.approx(bias)
    assert got == pytest.approx({i: weight(i) for i in range(41) if weight(i)})


def test_toxicity_without_labels(tables):
    docs, labels, rows, _ = tables
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and 0 < out.count() < len(rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_toxicity_learns_from_labelled_documents_that_are_there(tables):
    docs, labels, *_ = tables
    some, theirs = docs.filter("doc_id % 3 = 0"), labels.filter("doc_id % 3 = 0")
    assert np.array_equal(toxicity.train(some, labels, max_labelled=60), toxicity.train(some, theirs, max_labelled=60))
    assert toxicity.MAX_LABELLED == 20_000


def test_compact_coordinates_are_whole():
    for at in ([], [0], [65535, 65536, (1 << toxicity.BITS) - 1], range(3, 1 << toxicity.BITS, 777)):
        coded = toxicity.compact(np.array(at, dtype=np.int32))
        assert toxicity.expand(np.frombuffer(coded, np.uint8)).tolist() == list(at) and len(coded) == 64 + 2 * len(at)
