"""Best-fit packing of tokenized documents into fixed-length sequences, improved by swap-based local search.

Documents are tokenized once; only (doc_id, piece, start, length, checksum) rows go on. Pieces are dealt at random
into groups of about GROUP_PIECES rows, and each group is packed on its own: best fit over pieces in falling length,
then a local search between underfull bins. A move, a one-for-one or a two-for-one exchange is made only when it
raises the sum of squared fills, so that light bins drain into others until they are empty. Rounds go on until one
changes nothing. What a group cannot fill, the pieces of its bins below SPARSE of the capacity, is dealt anew with that
of the other groups, and packed again; so what is wasted at the end is that of a few groups, not of all.

In a round the lightest eighth of the bins give pieces away, each to the PARTNERS emptiest others; pairs are sought
among the PAIRED shortest pieces of a bin. These bounds lose no piece.

Edge cases: a null or empty text is the separator alone (one piece of length 1); texts longer than a sequence are
cut into full pieces and a rest; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import TEXT_BATCH_BYTES, by_slices, drop_tables, materialize
from almanac.llm.units import UnitCache, folded, joined_codes

CAPACITY = 2048
GROUP_PIECES = 4096
PARTNERS, PAIRED = 64, 24
# The words of the word-end tokenizer's splitter, and units of lower-case composed letters, digits and
# ASCII symbols but the apostrophe, whose words are known without it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _SYMBOLS = "a-zß-öø-ɏ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{_LETTERS}0-9{_SYMBOLS}]+")
WORD = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+")
#: Byte -> its character in a byte-level vocabulary: itself if it prints, else one of those from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _PRINTS} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTS}))}
#: Units that are encoded as one text.
JOINED_UNITS = 256
#: Texts whose distinct units are looked up together.
UNIT_TEXTS = 1024
#: Share of a sequence below which a bin of the first pass is dealt anew.
SPARSE = 0.9


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def _known_words(spec: dict) -> bool:
    """Whether the tokenizer leaves PLAIN units as they are, cuts them as WORD does, and finds special strings by "<|"."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and not before[1]["use_regex"] and not before[1]["add_prefix_space"]
    cuts = known and before[0]["pattern"] == {"Regex": SPLIT} and before[0]["behavior"] == "Removed" and before[0]["invert"]
    return bool(cuts and spec["model"]["type"] == "BPE" and all("<|" in x["content"] for x in spec["added_tokens"]))


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> UnitCache:
    """Unit -> its ids as little-endian unsigned 32-bit bytes.

    The words of PLAIN units, most units, go through the tokenizer's model alone. Other units are encoded many in one
    text, a bar between spaces after each: the tokenizer drops white space, and a bar that stands alone is one id, which
    units without a bar never give. Where any of this does not hold, units are encoded as they are, each by itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = _tokenizer(json.dumps(spec))
    by_words = _known_words(spec)  # encode keeps the tokenizer, not what it was made of
    del spec
    tokenize = whole.model.tokenize
    ids_of = lambda texts: [np.array(x.ids, "<u4") for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    (bar,) = ids_of(["|"])
    joins = len(bar) == 1

    def word_ids(unit: str) -> bytes:
        words = [unit] if unit.isalpha() else WORD.findall(unit)
        if not unit.isascii():
            words = [w.encode().decode("latin-1").translate(BYTE_CHARS) for w in words]
        ids = [x.id for w in words for x in tokenize(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(units: list[str]) -> list[bytes]:
        found = {u: word_ids(u) for u in units if PLAIN.fullmatch(u) and "<|" not in u and (u.isascii() or u == u.lower())} if by_words else {}
        rest = [u for u in units if u not in found and "|" not in u] if joins else []
        for lo in range(0, len(rest), JOINED_UNITS):
            part = rest[lo : lo + JOINED_UNITS]
            (ids,) = ids_of([" | ".join(part)])
            cuts = np.flatnonzero(ids == bar[0]) * 4
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                found.update((u, raw[x:y]) for u, x, y in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))
        left = [u for u in units if u not in found]
        found.update(zip(left, (x.tobytes() for x in ids_of(left))) if left else ())
        return [found[u] for u in units]

    return UnitCache(encode)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and deal (a number that spreads rows) for each piece of each document."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        ids = _word_ids(path)
        end, step = np.array([separator], "<u4").tobytes(), 4 * capacity
        row = 0

        def pieces(texts: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            data, ends = joined_codes([folded(x or "") for x in texts.column(1).to_pylist()], ids)
            owner, piece, length, crc = [], [], [], []
            for i, (lo, hi) in enumerate(zip(ends, ends[1:])):
                for k, at in enumerate(range(lo, hi + 4, step)):  # the separator, 4 bytes, ends the last piece
                    last = at + step > hi
                    part = data[at : hi if last else at + step]
                    owner.append(i)
                    piece.append(k)
                    length.append(len(part) // 4 + last)
                    crc.append(zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part))
            start = np.array(piece, np.int64) * capacity
            deal = np.arange(row, row + len(piece), dtype=np.int64)
            row += len(piece)
            arrays = [texts.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

        yield from by_slices(batches, pieces, UNIT_TEXTS)
        ids.old = {}  # the worker goes on to other work

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, deal long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes of ``lengths``: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set when a bin with room r exists
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, partners: int = PARTNERS) -> list[list[int]]:
    """Drain the lightest underfull bins into others by moves and exchanges that raise the squared fill.

    The emptiest bin in turn gives documents away: whole (move), against a smaller one (one for one), or two against
    one larger or two smaller than it gets back (two for one). ``partners`` bins with most room are tried for each.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_bins = [b for b in range(len(bins)) if fill[b] < capacity]
    changed = True
    while changed:  # every change raises the squared fill, so this ends
        changed = False
        open_bins.sort(key=lambda b: fill[b])
        for a in open_bins[: max(4, len(open_bins) // 8)]:
            for b in [x for x in open_bins if x != a and fill[a] <= fill[x] < capacity][:partners]:
                while fill[a] and fill[b] < capacity:
                    room = capacity - fill[b]
                    step = _exchange(bins[a], bins[b], lengths, room)
                    if not step:
                        break
                    give, take = step
                    for x in give:
                        bins[a].remove(x)
                    for x in take:
                        bins[b].remove(x)
                    bins[a] += take
                    bins[b] += give
                    gain = sum(lengths[x] for x in give) - sum(lengths[x] for x in take)
                    fill[a] -= gain
                    fill[b] += gain
                    changed = True
                if not fill[a]:
                    break
        open_bins = [b for b in open_bins if 0 < fill[b] < capacity]
    return [b for b in bins if b]


def _exchange(a: list[int], b: list[int], lengths: list[int], room: int):
    """(given by a, taken from b) with the largest gain of b that fits ``room``; None if there is none.

    b is at least as full as a, so every positive gain raises the squared fill and no state comes back.
    """
    best, step = 0, None
    mine = sorted((lengths[x], x) for x in a)
    theirs = sorted((lengths[y], y) for y in b)
    sizes = [n for n, _ in mine]
    at = bisect_right(sizes, room)
    if at:
        best, step = sizes[at - 1], ([mine[at - 1][1]], [])
    pairs = sorted((mine[i][0] + mine[j][0], mine[i][1], mine[j][1]) for i in range(min(len(mine), PAIRED)) for j in range(i + 1, min(len(mine), PAIRED)))
    sums = [x[0] for x in pairs]
    at = bisect_right(sums, room)
    if at and sums[at - 1] > best:
        best, step = sums[at - 1], ([*pairs[at - 1][1:]], [])
    for n, y in theirs:
        if best == room:
            break
        at = bisect_right(sizes, n + room)
        if at and sizes[at - 1] - n > best:
            best, step = sizes[at - 1] - n, ([mine[at - 1][1]], [y])
        at = bisect_right(sums, n + room)
        if at and sums[at - 1] - n > best:
            best, step = sums[at - 1] - n, ([*pairs[at - 1][1:]], [y])
    for i in range(min(len(theirs), PAIRED)):
        if best == room:
            break
        for j in range(i + 1, min(len(theirs), PAIRED)):
            n = theirs[i][0] + theirs[j][0]
            at = bisect_right(sizes, n + room)
            if at and sizes[at - 1] - n > best:
                best, step = sizes[at - 1] - n, ([mine[at - 1][1]], [theirs[i][1], theirs[j][1]])
    return step


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack(pieces: list[int], group: int, capacity: int, sparse: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a group; bins of less than ``sparse`` have the sequence -1."""
    sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for k, members in enumerate(pack_lengths(pieces, capacity)):
        at = 0
        for i in members:
            sequence[i], offset[i] = k + (group << 31), at
            at += pieces[i]
        if at < sparse:
            sequence[members] = -1
    return sequence, offset


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [("length", "descending"), ("ids_crc32", "ascending"), ("piece", "ascending"), ("deal", "ascending")]
    packed = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long"

    def passed(pieces: DataFrame, number: int, sparse: int) -> DataFrame:
        groups = max(1, -(-pieces.count() // group_pieces))
        dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "deal"), F.lit(groups)))

        def pack(rows: pa.Table) -> pa.Table:  # Arrow, not pandas: ids keep their type beside nulls
            rows = rows.sort_by(order)
            group = 2 * rows.column("group")[0].as_py() + number
            sequence, offset = _pack(rows.column("length").to_pylist(), group, capacity, sparse)
            return rows.select([*packed, "deal"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

        return dealt.groupBy("group").applyInArrow(pack, schema)

    pieces = materialize(tokenized_pieces(docs, path, capacity), "pieces", batch_bytes=TEXT_BATCH_BYTES)
    if pieces.count() <= group_pieces:
        return passed(pieces, 0, 0).drop("deal")
    first = materialize(passed(pieces, 0, int(SPARSE * capacity)), "packed")
    drop_tables(pieces)
    again = passed(first.filter("sequence_id < 0").select(*packed, "deal"), 1, 0)
    return first.filter("sequence_id >= 0").unionByName(again).drop("deal")
