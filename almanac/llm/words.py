"""Words of texts, and their 64-bit hashes, kept between batches by each worker process."""

from __future__ import annotations

from collections.abc import Iterator

import xxhash

#: Lower-cases A-Z and leaves spaces where bytes are neither letters nor digits nor of characters beyond ASCII.
_FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return (raw or b"").translate(_FOLD).split()


def word_slices(raw: bytes | None, size: int) -> Iterator[list[bytes]]:
    """The words of a text by slices of about ``size`` bytes, so that a long text is never held as words; one at least."""
    raw, at = raw or b"", 0
    while True:
        end = at + size
        while end < len(raw) and _FOLD[raw[end]] != 32:
            end += 1
        yield words_of(raw[at:end])
        at = end
        if at >= len(raw):
            return


KEEP_WORDS = 100_000
_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> list[int]:
    get = _hashes.get
    out = list(map(get, words))
    if None in out:
        if len(_hashes) > KEEP_WORDS:
            _hashes.clear()
        for i, x in enumerate(out):
            if x is None:
                out[i] = _hashes[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return out
