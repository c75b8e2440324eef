"""Cutting texts into units that tokenizers treat on their own, and caches of what each unit encodes to.

A space with a non-space character on both sides always starts a new pre-token of the byte-level pattern. In the
lower-casing word-end tokenizer white space never joins words, and a full stop or comma never joins the letters or
digits before it. Corpora repeat their words, so encoding each distinct unit once, with the library, gives what
encoding whole texts gives at a fraction of the time.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Executors run one task a core; the libraries' own threads would only compete with it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PAIR = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A stop or comma before a space or line end that may belong to a longer run of symbols.
_JOINED = re.compile(r"[.,](?<![^\W_][.,])(?=[ \n])")

#: Units kept by a worker process between batches, in two generations.
CACHE_UNITS = 400_000
#: Longer units are encoded where they occur and never kept.
CACHE_CHARS = 100


def spaced_units(text: str) -> list[str]:
    """Units of ``text``: the first as it is, each later one without the single space that precedes it."""
    if not text:
        return [""]
    return _SAFE.split(text) if _PAIR.search(text) else text.split(" ")


def folded(text: str) -> str:
    """``text`` with its units between single spaces, for a tokenizer that composes (NFC), lower-cases and drops white space.

    Special strings, all of which hold "<|", are found before any folding, so texts with that keep their case.
    """
    if "<|" in text:
        return text
    if not text.isascii():
        if "Σ" in text or not unicodedata.is_normalized("NFC", text):  # sigma's lower case depends on its place
            return text
    text = text.lower()
    if not _JOINED.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.replace("\n", " ")


def split_long(text: str, limit: int) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut before spaces that start a unit."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, max(at + limit - 1, at + 1))
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class UnitCache:
    """Encodings of units; new units of a batch are encoded together.

    Two generations: what the young one lacks is looked for in the old one and moves up. When the young one is full it
    becomes the old one, so units that return stay and those that came once go.
    """

    def __init__(self, encode):
        self.encode = encode
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, texts: list[list[str]]) -> list[list]:
        """For each text's units, their encodings in order."""
        if len(self.young) > CACHE_UNITS // 2:
            self.old, self.young = self.young, {}
        get = self.young.get
        out = [list(map(get, units)) for units in texts]
        gaps = [(row, units, [k for k, x in enumerate(row) if x is None]) for row, units in zip(out, texts) if None in row]
        if gaps:
            missing = {units[k] for _, units, places in gaps for k in places}
            fresh = {u: self.old[u] for u in missing if u in self.old}
            new = [u for u in missing if u not in fresh]
            fresh.update(zip(new, self.encode(new)) if new else ())
            for row, units, places in gaps:
                for k in places:
                    row[k] = fresh[units[k]]
            self.young.update((u, x) for u, x in fresh.items() if len(u) <= CACHE_CHARS)
        return out


def joined_codes(texts: list[str], cache: UnitCache) -> tuple[memoryview, list[int]]:
    """Encodings of all units of ``texts`` one after another, and where each text's begin, with the end of the last.

    Units lie between single spaces. Arrow cuts the texts and finds the distinct units; only these become strings here.
    """
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    units = cut.flatten().dictionary_encode()
    (codes,) = cache.lookup([units.dictionary.to_numpy(zero_copy_only=False).tolist()])
    _, places, data = pa.array(codes, pa.large_binary()).take(units.indices).buffers()
    return memoryview(data or b""), np.frombuffer(places, np.int64)[cut.offsets.to_numpy()].tolist()
