import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import materialise
from strandline.llm._tokens import tokens
from strandline.llm.packing import pack, pack_histogram

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " x  y", "a\x1cb", "½ ² x²3", "日本語 テスト", "<|endoftext|> hi", "don't I'LL we've  \n\n x", "naïve café— “q” …  ", "áb", "_x_ __ 12_3", "x" * 3000, " \t\r\n ", "€5 × 3 ÷ª º", "  z"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(reference, text):
    assert np.frombuffer(tokens(PATH).encode(text), "<u4").tolist() == reference(text)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    t.encode_special_tokens = True
    test_ids_of_any_text.t = t
    assert np.frombuffer(tokens(PATH).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 30), max_size=200))
@settings(max_examples=200, deadline=None)
def test_every_piece_is_packed_once(lengths):
    patterns = pack_histogram(Counter(lengths), 30)
    back = Counter()
    for p, n in patterns:
        assert n > 0 and sum(p) <= 30 and sum(3 * x > 30 for x in p) <= 2
        for x in p:
            back[x] += n
    assert back == Counter(lengths)


def test_packing_is_tight():
    rng = random.Random(3)
    lengths = Counter(min(2048, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(20_000))
    bins = sum(n for _, n in pack_histogram(lengths, 2048))
    assert bins <= 1.02 * max(sum(k * n for k, n in lengths.items()) / 2048, sum(n for k, n in lengths.items() if k > 1024))


def rows_of(reference, rows, capacity):
    for i, text in rows:
        ids = [*reference(text), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())


def test_pack(spark, reference):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "x9"]) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(300)]
    rows += [(7, "same"), (7, "same"), (None, "no id"), (900, None), (901, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rank int, task int").repartition(5)
    got = pack(df, PATH, capacity=64).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(rows_of(reference, rows, 64), key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by) <= 1.05 * total / 64 + 1
    assert pack(df.limit(0), PATH).collect() == []


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 64, 1000, 4097):
        slots = materialise.permute(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert n < 64 or slots.tolist() != materialise.permute(np.arange(n), n, key=5).tolist()


def records_of(folder, index, stride):
    """Slot to record, and the checks that every row of the index allows."""
    out = {}
    for r in index:
        body = (folder / f"shard-{r.shard:08d}.bin").read_bytes()
        out[r.slot] = body[r.byte_offset : r.byte_offset + stride]
        assert len(out[r.slot]) == stride and zlib.crc32(out[r.slot]) == r.record_crc32
    return out


def test_shards_round_trip(spark, reference, tmp_path):
    rng = random.Random(5)
    rows = [(i, "tok " * rng.choice([0, 1, 30])) for i in range(200)] + [(None, None), (3, "tok"), (3, "tok"), (400, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, slot int, ids int, parts int").repartition(4)
    folder = tmp_path / "shards"
    found = materialise.materialise(df, PATH, f"file://{folder}", length=16, per_shard=20)
    # the files are there before anything reads the index
    files = sorted(p.name for p in folder.glob("*.bin"))
    index = found.collect()
    records = records_of(folder, index, 32)
    n = len(records)
    assert sorted(records) == list(range(n)) and files == [f"shard-{s:08d}.bin" for s in range(-(-n // 20))]
    assert all(r.shard == r.slot // 20 and r.byte_offset == r.slot % 20 * 32 for r in index)
    parts = defaultdict(list)
    used = Counter()
    for r in index:
        ids = np.frombuffer(records[r.slot], "<u2").tolist()
        parts[r.doc_id].append((r.piece, r.start, ids[r["at"] : r["at"] + r.n_tokens]))
        used[r.slot] += r.n_tokens
    # every document is there whole, as often as it is in the table, and only a task's last record is filled up
    for i in {i for i, _ in rows}:
        want = Counter(tuple([*reference(t), materialise.END_ID]) for j, t in rows if j == i)
        pieces = sorted(parts[i])
        copies = sum(want.values())
        assert sum(len(ids) for *_, ids in pieces) == sum(len(t) * c for t, c in want.items())
        if copies == 1:
            assert [p for p, *_ in pieces] == list(range(len(pieces))) and tuple(x for *_, ids in pieces for x in ids) in want
            assert [s for _, s, _ in pieces] == [sum(len(ids) for *_, ids in pieces[:k]) for k in range(len(pieces))]
    assert sum(c < 16 for c in used.values()) <= 4
    assert materialise.materialise(df.limit(0), PATH).collect() == []


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    rows = [(i, "tok " * (i % 40)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = tmp_path / "shards"
    how = {"folder": f"file://{folder}", "length": 16, "per_shard": 20}
    # the same files read alike give the same order
    df.write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    before = sorted(map(tuple, materialise.materialise(df, PATH, **how).collect()))
    whole = {p.name: p.read_bytes() for p in folder.iterdir()}
    (folder / "shard-00000001.bin").write_bytes(b"half")
    (folder / "shard-00000002.bin").unlink()
    kept = (folder / "shard-00000000.bin").stat().st_mtime_ns
    assert sorted(map(tuple, materialise.materialise(df, PATH, **how).collect())) == before
    assert whole == {p.name: p.read_bytes() for p in folder.iterdir()} and kept == (folder / "shard-00000000.bin").stat().st_mtime_ns
    # shards of another key or input aren't taken for these
    with pytest.raises(ValueError, match="another order"):
        materialise.materialise(df, PATH, key=5, **how)
    with pytest.raises(ValueError, match="another order"):
        materialise.materialise(df.filter("doc_id < 50"), PATH, **how)
    # a file of the right size with other bytes isn't passed off as the shard
    (folder / "shard-00000000.bin").write_bytes(bytes(20 * 32))
    with pytest.raises(Exception, match="other records"):
        materialise.materialise(df, PATH, **how)
    (folder / "manifest.json").unlink()
    with pytest.raises(ValueError, match="without a manifest"):
        materialise.materialise(df, PATH, **how)


def test_wide_vocabularies_have_wide_ids():
    assert materialise.id_kind(PATH, 50256) == "<u2" and materialise.id_kind(PATH, 65_535) == "<u2" and materialise.id_kind(PATH, 65_536) == "<u4"
