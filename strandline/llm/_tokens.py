"""Byte-level BPE of whole texts, fast enough for corpora.

The vocabulary and its order come from a ``tokenizers`` JSON file. A text is cut by the
vocabulary's pattern, and the ids of each distinct piece are kept in a bounded table, so that
repeated pieces cost one look-up.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces to remember in each worker; the table is emptied when it is full.
REMEMBERED = 300_000
#: The pattern of byte-level BPE, written for ``re``. It cuts as the original does for the
#: characters that _PLAIN lets through.
_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t\n\r -~¡-§«´¶·»¿-ɏ‐-‧€]")
#: The original pattern, for all other texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others follow from U+0100 on, in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """``encode(text)``: the ids as little-endian unsigned 32-bit numbers, in bytes; ``size``: one
    more than the highest id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        core = getattr(self._bpe, "_core_bpe", None)
        self._piece = (lambda p: core.encode_single_piece(p.encode())) if hasattr(core, "encode_single_piece") else self._bpe.encode_ordinary
        self._known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text):
            return np.array(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()
        known = self._known
        pieces = _CUT.findall(text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = array("I", self._piece(p)).tobytes()
                    if len(p) <= 40:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """The encoder of a vocabulary file, made once in each worker."""
    return Tokens(path)
