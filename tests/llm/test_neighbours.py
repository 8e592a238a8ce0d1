import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import near_duplicates as nd
from strandline.llm import topk
from strandline.llm.graph import components


def links_of(texts):
    """Links of distinct texts by comparing all pairs of shingle sets."""
    sets = {t: set(nd.shingle_set(t).tolist()) for t in texts}
    order = sorted(sets)
    out = defaultdict(set)
    for i, a in enumerate(order):
        for b in order[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                out[a].add(b)
                out[b].add(a)
    return out


def near_corpus(rng, n=120):
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvw")
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 30, 80]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    big = [word() for _ in range(60)]
    for k in range(60):  # one large group, with edits that keep some pairs under the threshold
        copy = list(big)
        for _ in range(k % 4):
            copy[rng.randrange(60)] = word()
        rows.append((1_000 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_ROWS", block)
    rows = near_corpus(random.Random(block)) + [(5000, None), (5001, ""), (5002, "Ab, CD ef!"), (5003, "ab cd  EF"), (None, "ab cd ef"), (5002, "Ab, CD ef!"), (5004, "w " * 30_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, node string, key int, links int").repartition(5)
    got = nd.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = links_of({t or "" for _, t in rows})
    text = {i: t or "" for i, t in rows}
    groups = components_of(want, {t or "" for _, t in rows})
    for r in got:
        t = text[r.doc_id]
        assert r.n_links == len(want[t])
        assert r.n_copies == sum((x or "") == t for _, x in rows)
        assert r.copy_id == min((i for i, x in rows if (x or "") == t and i is not None), default=None)
        assert r.class_id == min(i for i, x in rows if groups[x or ""] == groups[t] and i is not None)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(groups[r.text or ""] for r in kept.collect()) == sorted(set(groups.values()))


def components_of(links, nodes):
    root = {}
    for start in sorted(nodes):
        if start in root:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += links[x]
    return root


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).collect() == [] and nd.drop_near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "same"), (1, "same"), (1, "same")], "doc_id long, text string")
    assert [tuple(r) for r in nd.drop_near_duplicates(df).collect()] == [(1, "same")]
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert len(nd.drop_near_duplicates(df).collect()) == 1


@pytest.mark.parametrize("target", [0.9, 0.999, 0.9999])
def test_prefixes_are_shortened_to_the_target(target):
    rng = random.Random(3)
    for _ in range(200):
        sizes = []
        for _ in range(rng.randrange(nd.TREES + 1)):
            at = sorted(rng.choices([1, 2, 5, 80, 10_000], k=nd.DEPTH - nd.SHORTEST + 1), reverse=True)
            sizes.append(tuple(at))
        absent = nd.TREES - len(sizes)
        depths = nd.matched_prefixes(sizes, absent, target)
        logs = absent * nd.missed(nd.SHORTEST) + sum(map(nd.missed, depths))
        assert logs <= np.log(1 - target) and all(nd.SHORTEST <= d <= nd.DEPTH for d in depths)
        # undoing any one step falls short of the target, or was free
        for n, d in zip(sizes, depths, strict=True):
            if d < nd.DEPTH and n[d - nd.SHORTEST] > n[d + 1 - nd.SHORTEST] and absent < 18:
                free = sum(nd.missed(x) - nd.missed(x + 1) for x in depths if x < nd.DEPTH)
                assert logs - free > np.log(1 - target)


def test_crowded_prefixes_stay_long():
    sizes = [(50_000, 40_000, 3)] * 6 + [(3, 3, 3)] * 18
    assert nd.matched_prefixes(sizes, 0) == [6] * 6 + [4] * 18 or sum(d == 6 for d in nd.matched_prefixes(sizes, 0)[:6]) >= 4


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    same = 0
    first = lambda x: nd.labels(x) >> (nd.LEVEL_BITS * (nd.DEPTH - 1))
    for _ in range(60):
        common = rng.integers(0, 1 << 62, 160).astype(np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 1 << 62, 20).astype(np.uint64)])) for _ in range(2))
        same += (first(a) == first(b)).mean()
    assert abs(same / 60 - 0.8) < 0.05


def test_all_texts_below_a_node_look_at_the_same(spark):
    """The places of two texts in a tree are the same node, or nodes of which none is above the other."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 60, nd.TREES)
    rows = []
    for i in range(80):
        own = base.copy()
        for t in range(nd.TREES):
            if rng.random() < 0.6:
                own[t] ^= int(rng.integers(1, 4)) << int(rng.choice([0, 10, 20, 30]))
        rows.append((bytes([i]), 10, own.tolist()))
    df = spark.createDataFrame(rows, "node binary, bytes long, labels array<bigint>")
    full = {r[0]: r[2] for r in rows}
    cut = lambda label, d: label >> (nd.LEVEL_BITS * (nd.DEPTH - d))
    by = defaultdict(list)
    for r in nd.looked_at(df).collect():
        assert r["at"] == cut(full[bytes(r.node)][r.tree], r.depth)
        by[r.tree].append((bytes(r.node), r.depth))
    for tree, mine in by.items():
        for n, d in mine:
            assert all(e == d for m, e in mine if cut(full[m][tree], d) == cut(full[n][tree], d))


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    links = defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == components_of(links, set(links))


# --- exact top-k ------------------------------------------------------------------------------


def brute(rows, k):
    """Every row with an id divisible by 20 against all other rows; rows are told apart by place."""
    ints = []
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v):
            ints.append((i, [int(np.floor(64 * float(x))) for x in v]))
    out = []
    for at, (q, one) in enumerate(ints):
        if q % 20 == 0:
            scored = [(-max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(one, v, strict=False)))), i) for n, (i, v) in enumerate(ints) if n != at]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ASKED = "vec_id % 20 = 0"


@pytest.mark.parametrize("limit", [8192, 4])
def test_topk_is_exact(spark, limit):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 8))]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many ties
    rows += [(2000, None), (2020, [1.0, None] * 4), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [1.0, 2.0]), (2100, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int, pos int, v int").repartition(3)
    got = topk.exact_topk(df, ASKED, 20, max_queries=limit)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(rows32, 20)


@pytest.mark.parametrize("copies", [1, 21, 400])
def test_copies_of_the_query_are_other_rows(spark, copies):
    rng = np.random.default_rng(6)
    far = [(int(i), rng.normal(0, 0.1, 8).tolist()) for i in range(1, 477) if i % 20]
    rows = [(0, [9.0] * 8)] * copies + far
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.exact_topk(df, ASKED, 20).collect()
    assert len(got) == 20 * copies and sorted(map(tuple, got)) == brute(rows, 20)


@pytest.mark.parametrize("turn", [1, -1])
def test_a_query_with_a_broken_namesake_is_answered(spark, turn):
    rows = [(20, [float("nan"), 1.0]), (20, [2.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0])][::turn]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.exact_topk(df, ASKED).orderBy("rank").collect()] == [(20, 1, 1), (20, 2, 2)]


def test_topk_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.exact_topk(spark.createDataFrame([], schema), ASKED).collect() == []
    rows = [(20, [1.0, 1e300]), (1, [2.0, 1e300]), (2, [0.5, -3.0]), (40, [1e40, -1e40]), (60, [3.0, 1.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, schema), ASKED, 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2)


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_bounds_hold(bits):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 20, (3000, 16)))
    x[:, 3] *= 1e6
    q = np.hstack([x[:40], rng.integers(-9, 9, (40, 3))])
    base, radius = topk.Cells.of(x, bits).bounds(q)
    scores = q[:, :16] @ x.T
    assert (np.abs(scores - base) <= radius[:, None]).all()


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """Cells of six bits leave a small share of all pairs to be read exactly."""
    rng = np.random.default_rng(7)
    rows = [(int(i), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(0, 1, (4000, 32)))]
    seen, real = [], topk._scored
    monkeypatch.setattr(topk, "_scored", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_topk(df, ASKED, 20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)
    assert seen[0] == 200 * 20 and 200 * 20 <= seen[1] < 0.05 * 200 * 4000


def test_floors_go_towards_minus_infinity():
    assert topk.floors([[-0.001, 0.5, float(np.float32(1 / 3))], [1.0]]).tolist() == [[-1, 32, 21], [64, 0, 0]]
