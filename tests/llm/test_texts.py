import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import fingerprints, licenses
from strandline.llm._text import fold, shingles, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_word_hashes_follow_the_pattern(text):
    got, want = word_hashes(fold(text)).tolist(), words(text)
    assert len(got) == len(want)
    assert len({(g, w) for g, w in zip(got, want, strict=True)}) == len(set(want)) == len(set(got))


def test_long_texts_hash_as_short_ones():
    one = word_hashes(fold("alpha"))[0]
    text = "alpha " + "y" * 700_000 + " alpha" + " beta" * 100_000 + " alpha"
    got = word_hashes(fold(text))
    assert len(got) == 100_004 and got[0] == got[2] == got[-1] == one


def test_shingles():
    h = word_hashes(b"a b c d e f")
    assert len(shingles(h)) == 2 and len(shingles(h[:3])) == 1 and len(shingles(h[:0])) == 0
    assert set(shingles(h[:5])) <= set(shingles(h))
    assert len(shingles(np.tile(h[:1], 100))) == 1


# --- licences ---------------------------------------------------------------------------------

VOCABULARY = "mit license apache general public gnu the of software licensed under free is x".split()


def brute(text):
    w = words(text)
    return len(w), sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


@given(st.lists(st.sampled_from(VOCABULARY), max_size=60))
@settings(max_examples=300, deadline=None)
def test_all_places_of_phrases(tokens):
    got = licenses._scanner().scan(" ".join(tokens))
    n, places = brute(" ".join(tokens))
    assert got["n_words"] == n and sorted((i, licenses.PHRASES[p][1]) for i, p in got["base"]) == places


def test_matching_statistics():
    """The automaton's longest matches against all substrings of its strings."""
    rng = random.Random(6)
    strings = [[rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    machine = licenses.Automaton(strings, [[0, 1]])
    known = {tuple(s[i:j]) for s in [*strings, [0, 1]] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(5) for _ in range(500)]
    state = length = 0
    for i, token in enumerate(text):
        while state and token not in machine.step[state]:
            state = machine.link[state]
            length = machine.size[state]
        state = machine.step[state].get(token, 0)
        length = length + 1 if state else 0
        want = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in known), default=0)
        assert length == want
        if length >= licenses.MIN_MATCH:
            places = {(s, e) for s, x in enumerate(strings) for e in range(len(x)) if e + 1 >= length and x[e + 1 - length : e + 1] == text[i + 1 - length : i + 1]}
            assert places <= set(machine.ends[state])


@pytest.mark.parametrize("at", range(len(licenses.TEMPLATES)))
def test_templates_are_found_also_when_edited(at):
    label, text = licenses.TEMPLATES[at]
    spans = licenses._scanner().scan(f"some words {text} more words")["spans"]
    assert any(licenses.TEMPLATES[t][0] == label and cover == 1 and first == 2 for t, first, _, cover in spans)
    tokens = text.split()
    if len(tokens) > 40:
        tokens[20:22] = ["something", "else"]
        spans = licenses._scanner().scan("pre " + " ".join(tokens))["spans"]
        assert any(licenses.TEMPLATES[t][0] == label and 0.9 < cover < 1 for t, *_, cover in spans)


def test_scan(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "Apache license; apache LICENSE"), (None, "plain"), (5, "mit-licenses"), (1, "Released under the MIT License."), (6, "mit license " * 20_000)]
    df = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, labels string, n_words int")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].labels, by[1].base_labels, by[1].n_base, by[1].first_word, by[1].score) == ("mit,mit-notice", "mit", 1, 3, 1.0)
    assert (by[4].n_base, by[4].first_word, by[4].last_word, by[4].base_labels, by[4].score) == (2, 0, 2, "apache", 0.5)
    assert (by[2].n_words, by[2].n_base, by[2].first_word, by[2].labels, by[2].score) == (0, 0, None, "", 0.0) == tuple(by[3][c] for c in ("n_words", "n_base", "first_word", "labels", "score"))
    assert by[5].n_base == 0 and by[6].n_base == 20_000
    assert licenses.scan(df.limit(0)).collect() == []


# --- fingerprints -----------------------------------------------------------------------------


def lz78(text):
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        if end > len(text):
            break
        seen.add(text[at:end])
        at = end
    return seen


@given(st.text(alphabet="abé\n", max_size=120), st.text(alphabet="abc", max_size=120))
@settings(max_examples=300, deadline=None)
def test_phrases_and_edited_parse(text, after):
    parsed = fingerprints.Parsed(text)
    assert len(parsed.hashes) == len(lz78(text)) == len(set(parsed.hashes.tolist()))
    edited, sig = parsed.edited(after)
    half = len(text) // 2
    assert edited == text[: len(text) - half] + after[:half]
    assert sig.tobytes() == fingerprints.Parsed(edited).signature.tobytes()


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        n = 4000
        common = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common)).astype(np.uint64)]) for _ in range(2))
        a, b = a * np.uint64(2), b * np.uint64(2)
        real = len(common) / (2 * n - len(common))
        assert abs(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - real) < 0.15


def test_fingerprint(spark):
    rng = random.Random(7)
    texts = {i: "".join(rng.choice("abc de") for _ in range(rng.randint(0, 400))) for i in rng.sample(range(10_000), 120)}
    rows = [*texts.items(), (20_000, "x" * 50_000), (20_001, "é" * 7), (20_002, None)]
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], "doc_id long, text string, part int, ahead string").repartition(6)
    for per in (11, 100_000):
        got = {r.doc_id: r for r in fingerprints.fingerprint(df, rows_per_partition=per).collect()}
        order = sorted(i for i, _ in rows)
        text = {i: t or "" for i, t in rows}
        assert set(got) == set(order)
        for k, i in enumerate(order):
            after = text[order[(k + 1) % len(order)]]
            half = len(text[i]) // 2
            edited = text[i][: len(text[i]) - half] + after[:half]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text[i])
            assert got[i].fingerprint == fingerprints.Parsed(text[i]).signature.tobytes().hex()
            assert got[i].edited_fingerprint == fingerprints.Parsed(edited).signature.tobytes().hex()
            assert 0 <= got[i].near_edited <= 1 and got[i].near_next == fingerprints.likeness(fingerprints.Parsed(text[i]).signature, fingerprints.Parsed(after).signature)


def test_fingerprint_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint(spark.createDataFrame([], schema)).collect() == []
    (one,) = fingerprints.fingerprint(spark.createDataFrame([(3, "only one")], schema)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, "none"), (None, "none")]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"]
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 1
