"""Vectorised word and shingle hashing of whole texts (NumPy, no object per word).

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z,
so ASCII letters, digits and everything beyond ASCII. Hashes are 64 bits wide and
the same in every process.
"""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes, cut between words.
_PIECE = 1 << 18

FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def fold(text: str | None) -> bytes:
    """UTF-8 of ``text`` with A-Z in lower case and every separator as a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POW = _powers(_BASE, _PIECE)
_INV = _powers(_INVERSE, _PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        _POW, _INV = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    return _POW, _INV


def _pieces(data: bytes):
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut + 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes, beginnings: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the words of folded ``data``, in order.

    With ``beginnings``, also those of the first so many bytes of each word that is longer, in
    further arrays (a list comes back).
    """
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(beginnings))]
    for piece in _pieces(data):
        raw = np.frombuffer(piece, dtype=np.uint8)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        power, inverse = _tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        found[0].append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        for own, n in zip(found[1:], beginnings, strict=True):
            at = starts[ends - starts > n]
            own.append(mix((total[at + n] - total[at]) * inverse[at] + np.uint64(1_000 + n)))
    out = [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in found]
    return out if beginnings else out[0]


_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words.

    A text of one to ``width - 1`` words has one shingle, all its words; an empty one has none.
    """
    if not len(words):
        return words
    if len(words) < width:
        width = len(words)
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = mix(out + words[i : i + n] * _SHINGLE[i % len(_SHINGLE)] + np.uint64(i)) if i else out + words[:n]
    return np.unique(out)
