"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each live position holds the rank of the pair that starts there; the tree's root is the smallest (rank, position), so
the leftmost pair of least rank is found at once and a merge costs a few logarithmic point updates on the merged
position and its live neighbours. Encoded units are kept, so each worker merges a distinct unit once.

Edge cases: a null text counts as empty (no ids, hash of nothing); any bytes and any length encode and decode exactly;
repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.units import UnitCache, spaced_units

#: The value of a leaf where no pair can merge.
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * width)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the next and the previous live token
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            tree[width + i] = r * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (root := tree[1]) < _NONE:
        i = root % n
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        p = before[i]
        changes = [(j, _NONE)]
        r = ranks.get(piece[i : after[k]]) if k < n else None
        changes.append((i, _NONE if r is None else r * n + i))
        if p >= 0:
            r = ranks.get(piece[p:k])
            changes.append((p, _NONE if r is None else r * n + p))
        for at, value in changes:
            at += width
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairTable:
    """(left id, right id) -> id of their concatenation, -1 if it is no token; every split of every token is listed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = 1 + max(ranks.values())
        found = {
            left * self.base + right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


def encode_many(pieces: list[bytes], pairs: PairTable, width: int) -> list[np.ndarray]:
    """Ids of each of ``pieces`` (at most ``width`` bytes, a power of two): one segment tree a piece, in lockstep.

    Every round takes each tree's root, merges there, and updates the three leaves that changed and their ancestors.
    Leaf value: rank * width + position.
    """
    m, w = len(pieces), width
    length = np.array([len(x) for x in pieces], np.int64)
    raw = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in pieces), np.uint8).reshape(m, w)
    place = np.arange(w, dtype=np.int64)
    ids = np.where(place < length[:, None], pairs.byte[raw], -1)
    after = np.broadcast_to(place + 1, (m, w)).copy()
    before = np.broadcast_to(place - 1, (m, w)).copy()
    tree = np.full((m, 2 * w), _NONE, np.int64)
    rows, cols = np.nonzero(place < (length - 1)[:, None])
    rank = pairs.find(ids[rows, cols], ids[rows, cols + 1])
    tree[rows, w + cols] = np.where(rank < 0, _NONE, rank * w + cols)
    at = w
    while at > 1:
        tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at //= 2
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    live = np.arange(m, dtype=np.int64)
    while len(live):
        root = tree[live * 2 * w + 1]
        live, root = live[root < _NONE], root[root < _NONE]
        if not len(live):
            break
        row, leaf, n = live * w, live * 2 * w, length[live]
        i = root % w
        j = after[row + i]
        k = after[row + j]
        ids[row + i] = root // w
        ids[row + j] = -1
        after[row + i] = k
        has_next = k < n
        before[(row + k)[has_next]] = i[has_next]
        rank = np.full(len(live), -1, np.int64)
        rank[has_next] = pairs.find(ids[(row + i)[has_next]], ids[(row + k)[has_next]])
        p = before[row + i]
        has_prev = p >= 0
        tree[leaf + w + j] = _NONE
        tree[leaf + w + i] = np.where(rank < 0, _NONE, rank * w + i)
        prev = pairs.find(ids[(row + p)[has_prev]], ids[(row + i)[has_prev]])
        tree[(leaf + w + p)[has_prev]] = np.where(prev < 0, _NONE, prev * w + p[has_prev])
        for base, node in ((leaf, w + j), (leaf, w + i), (leaf[has_prev], w + p[has_prev])):
            node = node >> 1
            while len(node) and node[0]:
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                node = node >> 1
    flat = ids.reshape(m, w)
    return [x[x >= 0] for x in flat]


class Codec:
    """Encoder and decoder of one ranks file; ids travel as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = {rank: np.array([rank], "<u4").tobytes() for rank in self.tokens}
        self.pairs = PairTable(self.ranks)
        self.after = UnitCache(lambda units: self._encode_units([" " + u for u in units]))

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Encodings of many short texts: pieces of like width together, long pieces one by one."""
        found: dict[bytes, bytes] = {}
        cut = [[x.encode() for x in self.pieces(u)] for u in units]
        waiting: dict[int, list[bytes]] = {8: [], 16: [], 32: [], 64: []}
        for piece in {p for x in cut for p in x}:
            if (whole := self.ranks.get(piece)) is not None:
                found[piece] = self.single[whole]
            elif len(piece) > 64:
                found[piece] = np.array(encode_piece(piece, self.ranks), "<u4").tobytes()
            else:
                waiting[max(8, 1 << (len(piece) - 1).bit_length())].append(piece)
        for width, pieces in waiting.items():
            for lo in range(0, len(pieces), 8192):
                part = pieces[lo : lo + 8192]
                found.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(part, encode_many(part, self.pairs, width)))
        return [b"".join([found[p] for p in x]) for x in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [spaced_units(x) for x in texts]
        firsts = self._encode_units([x[0] for x in cut])
        return [first + b"".join(x) for first, x in zip(firsts, self.after.lookup([x[1:] for x in cut]))]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(docs: DataFrame, path: str, pattern: str, make, columns: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in columns.split(", "))]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(own, [x or "" for x in part.column(1).to_pylist()])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for every row of ``docs`` (doc_id, text)."""
    return _mapped(docs, path, pattern, lambda own, texts: [pa.array(own.encode_batch(texts), pa.binary())], "ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the bytes decoded from them, without moving the ids."""

    def make(own, texts):
        ids = own.encode_batch(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(own.decode(x)) for x in ids])]

    return _mapped(docs, path, pattern, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
