"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles. Each of TREES trees gives a text a label of DEPTH min-hashes,
so a tree is the prefix trie of the labels in sorted order. Two texts are candidates if they
share a trie node that is looked at. Which nodes these are follows the data: a text starts at its
whole labels, and its prefixes are shortened one level at a time, in the tree where the next
shorter one adds the fewest other texts for what it adds to the recall, until a partner just
at the threshold, the hardest to find, is among the counted candidates with the target recall.
Texts that share a crowded prefix with many others thus stay deep in that tree and look at
shorter prefixes in others. A node that one text looks at counts for all texts below it.

Copies are folded first: everything after the first pass works on distinct texts. Trie nodes
with the same members are looked at once. The texts of a node are brought together, large
nodes in pairs of blocks, and every candidate's Jaccard likeness is computed from the whole
shingle sets; words and shingles stand there for themselves as 64-bit hashes. A pair counts in
the first tree that it shares, so its link counts once. What leaves a block is one row for each
text (its links, and the least text it hangs together with), never the pairs. Components of
these are the classes of near duplicates.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_written, fresh, maybe_broadcast, written
from ._text import fold, mix, shingles, word_hashes
from .graph import components

THRESHOLD = 0.8
#: Trees, levels of a label, and the shortest prefix that may be looked at.
TREES, DEPTH, SHORTEST = 24, 6, 4
#: Bits that a label keeps of each min-hash: equal hashes stay equal, and few others meet.
LEVEL_BITS = 10
#: Probability that a pair at the threshold becomes a candidate, at least.
TARGET_RECALL = 0.9999
#: Texts, and bytes of text, of a block of a large trie node.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: Keys with at least one row in so many are joined by broadcast; there are at most so many.
HOT_KEYS = 10_000
#: Shingles for which all hash functions are applied at a time.
_CHUNK = 512


def missed(depth: int, threshold: float = THRESHOLD) -> float:
    """Logarithm of the probability that two texts at the threshold differ within ``depth`` levels of a tree."""
    return log(1 - threshold**depth)


def matched_prefixes(sizes: list[tuple[int, ...]], absent: int, target: float = TARGET_RECALL) -> list[int]:
    """How long a prefix a text looks at in each tree.

    ``sizes``: for each tree in which others share its shortest prefix, the texts that share its
    prefix of SHORTEST to DEPTH levels; ``absent``: the trees in which none does, where the
    shortest prefix costs nothing.
    """
    depths = [DEPTH] * len(sizes)
    open_log = absent * missed(SHORTEST) + len(sizes) * missed(DEPTH) - log(1 - target)

    def step(tree: int) -> tuple[float, int]:
        d = depths[tree]
        more = sizes[tree][d - 1 - SHORTEST] - sizes[tree][d - SHORTEST]
        return more / (missed(d) - missed(d - 1)), tree

    following = [step(t) for t in range(len(sizes))]
    heapq.heapify(following)
    while open_log > 0 and following:
        _, tree = heapq.heappop(following)
        open_log -= missed(depths[tree]) - missed(depths[tree] - 1)
        depths[tree] -= 1
        if depths[tree] > SHORTEST:
            heapq.heappush(following, step(tree))
    return depths


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix(i * np.uint64(0x9E3779B97F4A7C15)), mix(i * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def labels(shingle_set: np.ndarray) -> np.ndarray:
    """The label in each tree: LEVEL_BITS of each of its min-hashes, the first level highest."""
    flip, scale = _seeds(TREES * DEPTH)
    least = np.full(TREES * DEPTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingle_set), _CHUNK):
        part = shingle_set[i : i + _CHUNK]
        np.minimum(least, ((part[None, :] ^ flip[:, None]) * scale[:, None]).min(axis=1), out=least)
    least = mix(least).reshape(TREES, DEPTH) >> np.uint64(64 - LEVEL_BITS)
    out = np.zeros(TREES, dtype=np.uint64)
    for i in range(DEPTH):
        out = out << np.uint64(LEVEL_BITS) | least[:, i]
    return out.view(np.int64)


def prefix(depth: int, label: str = "label") -> Column:
    """The first ``depth`` levels of a label."""
    return F.shiftright(label, LEVEL_BITS * (DEPTH - depth))


def shingle_set(text: str | None) -> np.ndarray:
    return shingles(word_hashes(fold(text)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """own_id, node (128-bit hash of the text), bytes and the labels of each row (none for no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, found = [], [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                nodes.append(hashlib.md5(raw, usedforsecurity=False).digest())
                sizes.append(len(raw))
                own = shingle_set(text)
                found.append(labels(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["own_id", "node", "bytes", "labels"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"own_id {kind}, node binary, bytes long, labels array<bigint>")


def looked_at(texts: DataFrame) -> DataFrame:
    """(node, tree, at, depth, bytes): the trie node that each text of ``texts`` (node, bytes,
    labels) is verified in, in every tree where it meets another there; ``at`` is its prefix of
    ``depth`` levels.
    """
    every = texts.filter("labels IS NOT NULL").select("node", "bytes", F.posexplode("labels").alias("tree", "label"))
    at = prefix(SHORTEST)
    shared = every.groupBy(F.col("tree").alias("s_tree"), at.alias("s_at")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared, "trie-nodes")
    met = every.join(maybe_broadcast(shared, shared.count()), (F.col("tree") == F.col("s_tree")) & (at == F.col("s_at")))
    met = written(met.select("node", "bytes", "tree", "label", F.col("n").alias(f"n{SHORTEST}")), "trie-members")
    sized = met
    for depth in range(SHORTEST + 1, DEPTH + 1):
        own = met.groupBy(F.col("tree").alias("d_tree"), prefix(depth).alias("d_at")).agg(F.count(F.lit(1)).alias(f"n{depth}"))
        sized = sized.join(own.filter(f"n{depth} > 1"), (F.col("tree") == F.col("d_tree")) & (prefix(depth) == F.col("d_at")), "left").drop("d_tree", "d_at")
    counts = [F.coalesce(f"n{d}", F.lit(1)).cast("long") for d in range(SHORTEST, DEPTH + 1)]
    # at most TREES entries for each text
    listed = sized.groupBy("node").agg(F.first("bytes").alias("bytes"), F.collect_list(F.struct("tree", "label", F.array(*counts).alias("sizes"))).alias("trees"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, trees in enumerate(b.column(2).to_pylist()):
                depths = matched_prefixes([t["sizes"] for t in trees], TREES - len(trees))
                out += [(i, t["tree"], t["label"], d) for t, d in zip(trees, depths, strict=True)]
            if out:
                i, tree, label, depth = zip(*out, strict=True)
                i = pa.array(i)
                columns = [b.column(0).take(i), b.column(1).take(i), pa.array(tree, pa.int32()), pa.array(label, pa.int64()), pa.array(depth, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "bytes", "tree", "label", "depth"])

    chosen = written(listed.mapInArrow(run, "node binary, bytes long, tree int, label long, depth int"), "trie-depths")
    # the shortest prefix that any text below a node looks at holds for all of them
    rows = chosen
    for depth in range(DEPTH - 1, SHORTEST - 1, -1):
        opened = chosen.filter(F.col("depth") == depth).select(F.col("tree").alias("o_tree"), prefix(depth).alias("o_at")).distinct()
        rows = rows.join(opened.withColumn("opened", F.lit(depth)), (F.col("tree") == F.col("o_tree")) & (prefix(depth) == F.col("o_at")), "left")
        rows = rows.withColumn("depth", F.least("depth", "opened")).drop("o_tree", "o_at", "opened")
    cut = F.expr(f"shiftright(label, {LEVEL_BITS} * ({DEPTH} - depth))")
    places = written(rows.select("node", "bytes", "tree", cut.alias("at"), "depth"), "trie-places")
    for done in (shared, met, chosen):
        drop_written(done)
    return places


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    out = np.zeros((n, n), dtype=np.float32)
    for start in range(0, len(shared), 4_096):
        at = (column >= start) & (column < start + 4_096)
        m = np.zeros((n, min(4_096, len(shared) - start)), dtype=np.float32)
        m[owner[at], column[at] - start] = 1
        out += m @ m.T
    return out


def verify(texts: list[str], keys: np.ndarray, sides: np.ndarray, tree: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that each text of a block counts in this tree, and the first text of its component.

    ``sides``: the block that each text comes from; with ``cross``, only pairs of two blocks count.
    The threshold test is exact: 9 * common >= 4 * (a + b) is a likeness of 0.8 or more.
    """
    sets = [shingle_set(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    common = _counts(sets)
    linked = 9 * common >= 4 * (sizes[:, None] + sizes[None, :])
    if cross:
        linked &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(np.triu(linked, 1))
    links = np.zeros(len(texts), dtype=np.int64)
    for i in range(0, len(a), 50_000):
        x, y = a[i : i + 50_000], b[i : i + 50_000]
        first = (keys[x] == keys[y]).argmax(axis=1) == tree
        np.add.at(links, x[first], 1)
        np.add.at(links, y[first], 1)
    root = np.arange(len(texts))
    while len(a):
        least = np.minimum(root[a], root[b])
        following = root.copy()
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        following = following[following]
        if (following == root).all():
            break
        root = following
    return links, root


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows (key, i, j, tree, side, node, keys, text) that follow each other, verified."""
    now, rows = None, []

    def done() -> pa.RecordBatch:
        texts = [r[4] for r in rows]
        # a tree in which a text is alone has a key of its own there: no other row has it
        keys = [[-1 - i if k is None else k for k in r[3]] for i, r in enumerate(rows)]
        links, root = verify(texts, np.array(keys), np.array([r[1] for r in rows]), rows[0][0], now[1] != now[2])
        nodes = [r[2] for r in rows]
        told = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in told], pa.binary()), pa.array([nodes[root[i]] for i in told], pa.binary()), pa.array(links[told], pa.int64())],
            names=["node", "with", "links"],
        )

    for b in batches:
        for key, i, j, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (key, i, j) != now:
                if len(rows) > 1:
                    yield done()
                now, rows = (key, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield done()


def _repeated(sig: DataFrame) -> DataFrame:
    """(own_id, own_node) of rows that are there more than once."""
    return sig.groupBy("own_id", F.col("node").alias("own_node")).count().filter("count > 1").drop("count")


def linked_texts(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """(node, with, links): parts of the links of distinct texts, and texts of the same component;
    a written table.

    ``repeated``: whether rows with the same id and text are there more than once.
    """
    spark = docs.sparkSession
    found = looked_at(texts)
    places = found.withColumn("key", F.xxhash64("tree", "depth", "at"))
    buckets = (
        places.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"), F.min("tree").alias("tree"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
        .filter("n > 1")
    )
    # trie nodes with the same members: the one of the first tree stands for all
    kept = buckets.groupBy("n", "size", "members").agg(F.min(F.struct("tree", "key")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    kept = written(kept.select(F.col("at.key").alias("b_key"), "n", F.least(blocks, F.col("n")).cast("int").alias("blocks")), "trie-kept")
    side = F.pmod(F.xxhash64("node", F.lit("side")), F.col("blocks")).cast("int")
    n_kept = kept.count()
    members = (
        places.join(maybe_broadcast(kept, n_kept), F.col("key") == F.col("b_key"), "left")
        .select(F.col("node").alias("m_node"), F.struct("tree", "key").alias("k"), F.when(F.col("blocks").isNotNull(), F.struct("key", "tree", "blocks", side.alias("side"))).alias("b"))
    )
    # one row for each text that is in any kept node, with at most TREES entries; keys: its node in
    # each tree, where it has one
    wanted = members.groupBy("m_node").agg(F.collect_list("b").alias("at"), F.map_from_entries(F.collect_list("k")).alias("of")).filter(F.size("at") > 0)
    wanted = wanted.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.col("of")[t])).drop("of")
    wanted = written(wanted.join(texts.select("node", "rep"), F.col("m_node") == F.col("node")).select("node", "rep", "keys", "at"), "trie-wanted")
    for done in (found, kept):
        drop_written(done)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("own_node"))
    chosen = own.join(wanted, (F.col("own_node") == F.col("node")) & F.col("own_id").eqNullSafe(F.col("rep")))
    if repeated:
        chosen = chosen.dropDuplicates(["own_node"])
    # written, so that the exchange of all texts is gone before the blocks are dealt
    chosen = written(chosen.select("node", "keys", "text", "at"), "trie-texts")
    drop_written(wanted)
    rows = chosen.select("node", "keys", "text", F.explode("at").alias("b"))
    pair = F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1))
    rows = rows.select("node", "keys", "text", "b", pair.alias("other"))
    rows = rows.select(
        F.col("b.key").alias("key"), F.least("b.side", "other").alias("i"), F.greatest("b.side", "other").alias("j"),
        F.col("b.tree").alias("tree"), F.col("b.side").alias("side"), "node", "keys", "text",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_verified, "node binary, with binary, links long")
    links = written(links, "links")
    drop_written(chosen)
    return links


def _spread_join(rows: DataFrame, by: str, side: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with the one row of ``side`` whose ``key`` is their ``by``; ``n`` is how many
    rows of ``rows`` that is.

    All rows of a frequent key would meet in one task, so keys that hold a share of at least one in
    HOT_KEYS of all rows, which are at most HOT_KEYS, are broadcast; only rows of the others move.
    """
    hot = F.col(n) * HOT_KEYS >= rows.count()
    same = F.col(by) == F.col(key)
    rare = rows.join(F.broadcast(side.filter(hot).select(key)), same, "left_anti")
    return rows.join(F.broadcast(side.filter(hot)), same).unionByName(rare.join(side.filter(~hot), same))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and for each distinct text: own_node, rep, n_copies, n_links, root."""
    sig = written(signatures(docs, id_col, text_col), "signatures")
    distinct = sig.groupBy("node").agg(
        F.min("own_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bytes").alias("bytes"), F.first("labels").alias("labels")
    )
    texts = written(distinct, "texts")
    # labels are kept once
    rows = written(sig.select("own_id", "node"), "rows")
    drop_written(sig)
    sig = rows
    found = linked_texts(docs, texts, id_col, text_col, not _repeated(sig).isEmpty())
    roots = components(found.select(F.col("node").alias("u"), F.col("with").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = texts.select(F.col("node").alias("own_node"), "rep", "n_copies")
    named = named.join(roots, F.col("own_node") == F.col("node"), "left").drop("node")
    named = named.join(links, F.col("own_node") == F.col("node"), "left").drop("node")
    named = named.withColumn("root", F.coalesce("root", "own_node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    named = written(named, "classes")
    for done in (texts, found, roots):
        drop_written(done)
    return sig, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near duplicates: one row for each row of ``docs``.

    Columns: the id; ``class_id``, the least id of all documents that it hangs together with by
    links; ``n_links``, the different texts that it is linked with (Jaccard likeness of
    five-word shingle sets 0.8 or more); ``copy_id``, the least id of documents with the same
    text; ``n_copies``, how many these are; ``class_key``, a hash that names the class.

    Defined cases: null texts are empty; empty texts are copies of each other and have no other
    links; a text of one to four words has one shingle; null ids are passed over in least ids,
    which are null where no other is there; repeated rows are copies; other columns are not
    looked at; an empty table gives no rows.
    """
    sig, named = _classes(docs, id_col, text_col)
    least = named.groupBy(F.col("root").alias("c_root")).agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    named = written(_spread_join(named, "root", written(least, "least-ids"), "c_root", "n_texts"), "named")
    return _spread_join(sig, "node", named, "own_node", "n_copies").select(
        F.col("own_id").alias(id_col), "class_id", "n_links", F.col("rep").alias("copy_id"), "n_copies", F.hex("root").alias("class_key"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with its columns: the one with the least id (null last; of
    rows with the same id, one with the least text hash; of equal rows, one)."""
    sig, named = _classes(docs, id_col, text_col)
    rows = _spread_join(sig, "node", named.select("own_node", "n_copies", "root"), "own_node", "n_copies")
    choice = F.min(F.struct(F.col("own_id").isNull().alias("none"), F.col("own_id"), F.col("node"))).alias("m")
    h, n, k_id, k_node = fresh(docs, "h", "n", "k_id", "k_node")
    kept = rows.groupBy("root").agg(choice).select(F.col("m.own_id").alias(k_id), F.col("m.node").alias(k_node))
    kept = written(kept, "kept")
    same = (F.col("own_node") == F.col(k_node)) & F.col("own_id").eqNullSafe(F.col(k_id))
    hashed = docs.withColumn(h, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    out = hashed.join(kept, (F.col(h) == F.col(k_node)) & F.col(id_col).eqNullSafe(F.col(k_id)), "left_semi")
    if not _repeated(sig).join(kept, same, "left_semi").isEmpty():
        one = Window.partitionBy(h, id_col).orderBy(F.lit(1))
        out = out.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
