"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed left to right into phrases, each the shortest string that is not yet in the
dictionary (LZ78). What compresses one text with the dictionary of another are common phrases,
so the likeness of two texts is the Jaccard likeness of their phrase sets. It is estimated from
minimum-hash signatures: phrase hashes are dealt over BINS bins, each keeps its least hash, and
an empty bin borrows from the next one that is not. The signature keeps 8 bits of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _tables, mix

BINS = 128
#: Documents for each partition of the exchange, about.
ROWS_PER_PARTITION = 20_000


def phrases(text: str, start: int, seen: set[str], limit: int) -> list[int]:
    """Parse ``text`` from ``start`` while phrases end within ``limit``: new phrases go to
    ``seen``, and their ends are returned.

    Each prefix of a phrase is a phrase, so a phrase's length is found from a guess, the length
    of the one before. An unfinished phrase at the end of the text is not new and is left out.
    """
    n, at, length = len(text), start, 1
    ends: list[int] = []
    while at < n:
        end = min(at + length, n)
        phrase = text[at:end]
        if phrase in seen:
            while phrase in seen:
                if end == n:
                    return ends
                end += 1
                phrase = text[at:end]
        else:
            while end - at > 1 and (shorter := text[at : end - 1]) not in seen:
                phrase = shorter
                end -= 1
        if end > limit:
            return ends
        seen.add(phrase)
        ends.append(end)
        length = end - at
        at = end
    return ends


def phrase_hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """Hashes of the adjoining phrases of ``text`` from ``start`` on."""
    if not ends:
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    power, inverse = _tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * power[: len(codes)], out=total[1:])
    stop = np.array(ends, dtype=np.int64) - start
    first = np.concatenate([[0], stop[:-1]])
    return mix((total[stop] - total[first]) * inverse[first] + (stop - first).astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS bytes; of no phrases: none."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint8)
    hashes = np.sort(hashes)
    dealt = hashes >> np.uint64(57)
    first = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
    bins, least = dealt[first], hashes[first]
    at = np.searchsorted(bins, np.arange(BINS, dtype=np.uint64))
    lent = at == len(bins)
    at[lent] = 0
    gap = (bins[at].astype(np.int64) - np.arange(BINS)) % BINS
    return (mix(least[at] + gap.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two phrase sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = float(np.count_nonzero(a == b)) / BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


class Parsed:
    """A text's signature, and its parse as far as its kept first half goes."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.kept = len(self.text) - len(self.text) // 2
        seen: set[str] = set()
        ends = phrases(self.text, 0, seen, self.kept)
        self.half = (set(seen), len(ends))
        self.at = ends[-1] if ends else 0
        ends += phrases(self.text, self.at, seen, len(self.text))
        self.hashes = phrase_hashes(self.text, 0, ends)
        self.signature = signature(self.hashes)

    def edited(self, after: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the beginning of ``after``, and its signature.
        May be called once."""
        text = self.text[: self.kept] + after[: len(self.text) // 2]
        seen, n = self.half
        ends = phrases(text, self.at, seen, len(text))
        return text, signature(np.concatenate([self.hashes[:n], phrase_hashes(text, self.at, ends)]))


_SCHEMA = "own_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in ascending order of a numeric id.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or
    all) of the next document; the first follows the last. Columns: the id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited and near_next
    (likeness to the edited text's and to the next document's fingerprint).

    Texts move once, to ranges of ids; the first row of a range also goes to the range before.

    Defined cases: a null text is empty; an empty text has the empty fingerprint, which is like
    no other than itself; null ids come last; equal ids are ordered by a hash of the text, and
    rows equal in both are interchangeable; a single document follows itself; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    n = own.count()
    parts = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_partition))))
    marks = [i / parts for i in range(1, parts)]
    found = own.agg(F.percentile_approx("own_id", marks, max(10_000, 100 * parts)).alias("q")).first().q if marks else None
    edges = np.unique(np.array(found or [], dtype=np.int64))
    last = len(edges)

    def part_of(ids: pa.Array) -> np.ndarray:
        out = np.searchsorted(edges, ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), side="left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), last, out)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids), pa.int32())

    # one row for each range: its first id
    firsts = own.select(part("own_id").alias("part"), "own_id").groupBy("part").agg(F.min("own_id").alias("first")).collect()
    first = {r.part: r.first for r in sorted(firsts, key=lambda r: r.part)}
    order = list(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    @F.arrow_udf("array<struct<part: int, ahead: int>>")
    def places(ids: pa.Array) -> pa.Array:
        out = []
        for p, i in zip(part_of(ids).tolist(), ids.to_pylist(), strict=True):
            here = [{"part": p, "ahead": 0}]
            out.append([*here, {"part": before[p], "ahead": 1}] if i == first[p] else here)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("ahead", pa.int32())])))

    moved = own.withColumn("place", F.explode(places("own_id"))).select("own_id", "own_text", "place.part", "place.ahead")
    moved = moved.repartitionById(last + 1, F.col("part")).sortWithinPartitions("ahead", F.col("own_id").asc_nulls_last(), F.xxhash64("own_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[object, Parsed] | None = None
        ended = False
        for b in batches:
            out: list[tuple] = []
            for i, text, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if ended:
                    break
                parsed = Parsed(text)
                if waiting is not None:
                    key, one = waiting
                    edited, sig = one.edited(parsed.text)
                    out.append((
                        key, len(one.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        one.signature.tobytes().hex(), sig.tobytes().hex(), likeness(one.signature, sig), likeness(one.signature, parsed.signature),
                    ))
                waiting, ended = (i, parsed), bool(ahead)
            if out:
                ids, *cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                    names=["own_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return moved.mapInArrow(run, _SCHEMA.format(kind=kind)).withColumnRenamed("own_id", id_col)
