"""Media columns: progressive JPEG, decoded scan by scan into coefficient arrays and RGB tensors.

The decoder accumulates spectral selection (bands of coefficients) and successive approximation (bit planes) into one
coefficient array a component, inverse-transforms the blocks in numpy, upsamples chroma by replication and gives a
full-resolution height x width x 3 tensor. Any baseline-ordered Huffman progressive stream decodes bit by bit; scans
whose table gives every symbol the same width (code and extra bits: 16) decode as arrays, which is how this module
writes them.

The encoder stores bytes losslessly in the format's unit, the quantized coefficient: byte v becomes the coefficient
that JPEG's 8 extra bits v stand for (v, or v - 255 below 128), 64 bytes a block, with all quantizers 1.

Edge cases: null and empty texts hold 64 zero bytes; every length up to 6.4 GB, beyond any Spark value, pads to
a multiple of 64; equal texts give equal
bytes, tensors and features; repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.common import drop_tables, materialize

BLOCK = 64
#: Blocks of a unit of 16 x 16 pixels: four of luma, one of each chroma.
UNIT_BLOCKS = 6
#: Units in a row of an image, and rows of units that a frame's 16-bit height allows; larger payloads get wider images.
UNITS_ACROSS = 64
UNITS_DOWN = 4095
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _zigzag() -> np.ndarray:
    """Place in a row-major 8 x 8 block of each coefficient in scan order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_SHIFT = 11


@functools.cache
def _basis() -> np.ndarray:
    """Scan-order coefficient -> 64 pixels, as integers scaled by 2 ** _SHIFT, so that sums are exact in any order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(0.5), 1.0) * np.cos((2 * x + 1) * k * np.pi / 16) / 2
    full = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << _SHIFT))


# Huffman tables


@dataclass
class Table:
    """A canonical Huffman table: symbols by code length, with lookups from 16 leading bits."""

    counts: list[int]
    symbols: list[int]
    ac: bool
    code: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.symbol = np.full(1 << 16, -1, np.int16)
        self.length = np.zeros(1 << 16, np.int8)
        at, code = 0, 0
        for n, count in enumerate(self.counts, 1):
            for _ in range(count):
                s = self.symbols[at]
                self.code[s] = (code, n)
                lo = code << (16 - n)
                self.symbol[lo : lo + (1 << (16 - n))] = s
                self.length[lo : lo + (1 << (16 - n))] = n
                at, code = at + 1, code + 1
            code <<= 1
        self.even = all(n + self.extra(s) == 16 for s, (_, n) in self.code.items())

    def extra(self, s: int) -> int:
        """Bits that follow symbol ``s`` in a first scan."""
        if not self.ac:
            return s
        return s & 15 or (s >> 4 if s >> 4 < 15 else 0)


@functools.cache
def even_table(ac: bool) -> Table:
    """The table that gives every symbol 16 bits in all, code and extra bits together."""
    symbols = [r << 4 | s for r in range(16) for s in range(11)] if ac else list(range(12))
    by_length: dict[int, list[int]] = {n: [] for n in range(1, 17)}
    for s in symbols:
        by_length[16 - ((s & 15 or (s >> 4 if s >> 4 < 15 else 0)) if ac else s)].append(s)
    return Table([len(by_length[n]) for n in range(1, 17)], [s for n in range(1, 17) for s in by_length[n]], ac)


# Encoder


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Luma blocks (raster order) as interleaved scans visit them: 2 x 2 for each unit."""
    return np.arange(4 * across * down).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1)


def _dc_words(dc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    diff = np.diff(dc, prepend=0)
    size = np.where(diff == 0, 0, np.frexp(np.abs(diff).astype(np.float64))[1])
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return codes[size] | bits


def encode_coefficients(parts: list[np.ndarray], across: int, down: int, comment: bytes = b"") -> bytes:
    """A progressive JPEG (4:2:0) of full coefficient arrays (blocks x 64, scan order) for Y, Cb and Cr.

    Every AC coefficient must have a magnitude of 128 to 255, as stored bytes do.
    """
    dc_table, ac_table = even_table(False), even_table(True)
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\1\x22\0\2\x11\0\3\x11\0"))
    for t in (dc_table, ac_table):
        out.append(_segment(0xC4, bytes([16 * t.ac, *t.counts, *t.symbols])))
    # first planes of DC, interleaved
    codes = np.array([dc_table.code[s][0] << s for s in range(12)], np.int64)
    order = _mcu_order(across, down)
    words = np.empty((across * down, UNIT_BLOCKS), ">u2")
    words[:, :4] = _dc_words(parts[0][order, 0] >> 1, codes).reshape(-1, 4)
    words[:, 4], words[:, 5] = (_dc_words(p[:, 0] >> 1, codes) for p in parts[1:])
    out += [_segment(0xDA, b"\3\1\0\2\0\3\0\0\0\x01"), _stuffed(words.tobytes())]
    code, length = ac_table.code[7]
    for ss, se in ((1, 5), (6, 63)):
        for c, p in enumerate(parts, 1):
            v = p[:, ss : se + 1]
            v = np.where(v < 0, 127 - (-v >> 1), v >> 1)
            out += [_segment(0xDA, bytes([1, c, 0, ss, se, 0x01])), _stuffed((v.astype(np.uint16) | np.uint16(code << 7)).astype(">u2").tobytes())]
    # second planes: one bit a coefficient
    bits = np.empty((across * down, UNIT_BLOCKS), np.uint8)
    bits[:, :4] = (parts[0][order, 0] & 1).reshape(-1, 4)
    bits[:, 4], bits[:, 5] = (p[:, 0] & 1 for p in parts[1:])
    out += [_segment(0xDA, b"\3\1\0\2\0\3\0\0\0\x10"), _stuffed(_packed(bits.ravel()))]
    for c, p in enumerate(parts, 1):
        bits, runs = (np.abs(p[:, 1:]) & 1).astype(np.uint8), []
        for lo in range(0, len(p), 32767):
            n = min(32767, len(p) - lo)
            r = n.bit_length() - 1
            code, length = ac_table.code[r << 4]
            word = code << r | n - (1 << r)
            runs += [np.array([word >> 8, word & 255], np.uint8), bits[lo : lo + n].ravel()]
        runs = [np.unpackbits(x) if i % 2 == 0 else x for i, x in enumerate(runs)]
        out += [_segment(0xDA, bytes([1, c, 0, 1, 63, 0x10])), _stuffed(_packed(np.concatenate(runs)))]
    return b"".join([*out, b"\xff\xd9"])


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def image_units(units: int) -> tuple[int, int]:
    """Units across and down of the image that holds ``units`` of them."""
    across = min(units, max(UNITS_ACROSS, -(-units // UNITS_DOWN)))
    down = -(-units // across)
    if across > UNITS_DOWN:
        raise ValueError(f"an image holds {UNITS_DOWN**2 * UNIT_BLOCKS * BLOCK} bytes at most")
    return across, down


def encode_bytes(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of 64 bytes); a comment keeps its length."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must fill whole blocks")
    units = -(-len(payload) // (BLOCK * UNIT_BLOCKS))
    across, down = image_units(units)
    raw = np.zeros(across * down * UNIT_BLOCKS * BLOCK, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = raw.astype(np.int16).reshape(-1, BLOCK)
    values = np.where(values < 128, values - 255, values).astype(np.int16)
    n = across * down
    return encode_coefficients([values[: 4 * n], values[4 * n : 5 * n], values[5 * n :]], across, down, struct.pack(">Q", len(payload)))


# Decoder


class _Bits:
    """Bits of one scan, read one by one or in runs."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        short = self.at + n - len(self.bits)
        self.at += n
        return v << short if 0 < short < n else v if short <= 0 else 0

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        self.at += n
        return got if len(got) == n else np.concatenate([got, np.zeros(n - len(got), np.uint8)])

    def symbol(self, table: Table) -> int:
        at = self.at
        word = self.take(16)
        n = int(table.length[word])
        if not n:
            raise ValueError("a code that the table lacks")
        self.at = at + n
        return int(table.symbol[word])


def _extend(v: int, s: int) -> int:
    return v if s == 0 or v >= 1 << (s - 1) else v - (1 << s) + 1


@dataclass
class _Part:
    h: int
    v: int
    q: int
    across: int = 0  # blocks of the component that hold pixels
    down: int = 0
    stride: int = 0  # blocks a row with those that fill the last unit
    blocks: np.ndarray | None = None


class Decoder:
    """One image: reads segments in turn and accumulates scans into coefficient arrays."""

    def __init__(self, data: bytes):
        self.comment, self.quant, self.tables, self.parts, self.restart = b"", {}, {}, {}, 0
        self.height = self.width = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                return
            end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : end]
            at = end
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantizers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                found = _MARKER.search(data, at)
                if not found:
                    raise ValueError("a scan without an end")
                self._scan(body, data[at : found.start()])
                at = found.start()
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only progressive Huffman frames are read")

    def _quantizers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = sum(counts)
            ac, own = bool(body[0] >> 4), even_table(bool(body[0] >> 4))
            same = counts == own.counts and list(body[17 : 17 + n]) == own.symbols
            self.tables[ac, body[0] & 15] = own if same else Table(counts, list(body[17 : 17 + n]), ac)
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.parts[c] = _Part(hv >> 4, hv & 15, q)
        self.h, self.v = max(p.h for p in self.parts.values()), max(p.v for p in self.parts.values())
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts.values():
            p.across = -(-(-(-self.width * p.h // self.h)) // 8)
            p.down = -(-(-(-self.height * p.v // self.v)) // 8)
            p.stride = self.across * p.h
            p.blocks = np.zeros((p.stride * self.down * p.v, BLOCK), np.int32)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        ss, se, planes = body[1 + 2 * n : 4 + 2 * n]
        high, low = planes >> 4, planes & 15
        # blocks in the order of the scan: units of all components, or one component's own blocks
        if n > 1:
            visits = [np.arange(p.stride * self.down * p.v).reshape(self.down, p.v, self.across, p.h).transpose(0, 2, 1, 3).reshape(self.across * self.down, -1) for p, _ in chosen]
        else:
            p = chosen[0][0]
            visits = [(np.arange(p.down)[:, None] * p.stride + np.arange(p.across)).reshape(-1, 1)]
        parts = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        step = self.restart or len(visits[0])
        for i, raw in enumerate(parts):
            rows = [v[i * step : (i + 1) * step] for v in visits]
            raw = raw.replace(b"\xff\x00", b"\xff")
            if ss == 0:
                (self._dc_refine if high else self._dc_first)(chosen, rows, raw, low)
            elif high:
                self._ac_refine(*chosen[0], rows[0].ravel(), raw, ss, se, low)
            else:
                self._ac_first(*chosen[0], rows[0].ravel(), raw, ss, se, low)

    def _dc_first(self, chosen, rows, raw: bytes, low: int) -> None:
        tables = [self.tables[False, t >> 4] for _, t in chosen]
        widths = [r.shape[1] for r in rows]
        total = len(rows[0]) * sum(widths)
        if all(t.even for t in tables) and len(raw) >= 2 * total:
            words = np.frombuffer(raw, ">u2", total).reshape(-1, sum(widths))
            at = 0
            for (p, _), r, t, w in zip(chosen, rows, tables, widths):
                own = words[:, at : at + w].ravel()
                s = t.symbol[own].astype(np.int64)
                bits = own & ((1 << s) - 1)
                diff = np.where((s > 0) & (bits < 1 << np.maximum(s - 1, 0)), bits - (1 << s) + 1, bits)
                p.blocks[r.ravel(), 0] = np.cumsum(diff) << low
                at += w
            return
        bits, last = _Bits(raw), [0] * len(chosen)
        for u in range(len(rows[0])):
            for c, (p, _) in enumerate(chosen):
                for b in rows[c][u]:
                    s = bits.symbol(tables[c])
                    last[c] += _extend(bits.take(s), s)
                    p.blocks[b, 0] = last[c] << low

    def _dc_refine(self, chosen, rows, raw: bytes, low: int) -> None:
        widths = [r.shape[1] for r in rows]
        got = _Bits(raw).many(len(rows[0]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
        at = 0
        for (p, _), r, w in zip(chosen, rows, widths):
            p.blocks[r.ravel(), 0] |= got[:, at : at + w].ravel() << low
            at += w

    def _ac_first(self, p: _Part, t: int, rows, raw: bytes, ss: int, se: int, low: int) -> None:
        table, band = self.tables[True, t & 15], se - ss + 1
        if table.even and len(raw) % 2 == 0:
            words = np.frombuffer(raw, ">u2").astype(np.uint16)
            symbol = table.symbol[words]
            if symbol.size == len(rows) * band and symbol.size and 0 < symbol[0] < 16 and (symbol == symbol[0]).all():
                top = (1 << int(symbol[0])) - 1  # every coefficient is there, and all have as many bits
                v = (words & np.uint16(top)).astype(np.int32)
                v = np.where(v <= top >> 1, v - top, v) << low
                p.blocks[rows, ss : se + 1] = v.reshape(len(rows), band)
                return
            s = symbol & 15
            if s.size and s.min() > 0:  # neither ends of blocks nor long runs of zeros
                place = np.cumsum((symbol >> 4).astype(np.int64) + 1) - 1
                if place[-1] == len(rows) * band - 1:
                    s = s.astype(np.int64)
                    v = words & ((1 << s) - 1)
                    v = np.where(v < 1 << (s - 1), -((1 << s) - 1 - v << low), v << low)
                    p.blocks[rows[place // band], ss + place % band] = v
                    return
        bits, run = _Bits(raw), 0
        for b in rows:
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                if s:
                    k += r
                    v = _extend(bits.take(s), s)
                    p.blocks[b, k] = v << low if v >= 0 else -(-v << low)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    def _ac_refine(self, p: _Part, t: int, rows, raw: bytes, ss: int, se: int, low: int) -> None:
        table, bits, plane = self.tables[True, t & 15], _Bits(raw), 1 << low
        i = 0

        def correct(blocks: np.ndarray, k: int) -> None:
            """One bit for each coefficient from ``k`` on that is not zero yet, block by block."""
            band = p.blocks[blocks, k : se + 1]
            set_ = band != 0
            got = bits.many(int(np.count_nonzero(set_))).astype(np.int32) * plane
            band[set_] += np.where(band[set_] > 0, got, -got)
            p.blocks[blocks, k : se + 1] = band

        while i < len(rows):
            block, k = p.blocks[rows[i]], ss
            while k <= se:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                if not s and r < 15:
                    n = (1 << r) + bits.take(r)
                    if k > ss:
                        correct(rows[i : i + 1], k)
                        correct(rows[i + 1 : i + n], ss)
                    else:
                        correct(rows[i : i + n], ss)
                    i += n - 1
                    break
                new = (plane if bits.take(1) else -plane) if s else 0
                while k <= se:
                    if block[k]:
                        if bits.take(1):
                            block[k] += plane if block[k] > 0 else -plane
                    elif r == 0:
                        block[k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            i += 1

    def planes(self) -> list[np.ndarray]:
        """Each component at full resolution, uint8."""
        out = []
        for p in self.parts.values():
            quant = self.quant[p.q]
            values = p.blocks if (quant == 1).all() else p.blocks * quant
            kind = np.float32 if np.abs(values).max(initial=0) < 512 else np.float64  # sums stay exact
            flat = values.astype(kind) @ _basis().astype(kind)
            pixels = flat.astype(np.int32)
            pixels += (1 << (_SHIFT - 1)) + (128 << _SHIFT)  # rounded, about 128
            pixels >>= _SHIFT
            pixels = np.clip(pixels, 0, 255, out=pixels).astype(np.uint8)
            plane = pixels.reshape(-1, p.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * p.stride)
            plane = plane.repeat(self.v // p.v, 0).repeat(self.h // p.h, 1) if (self.v, self.h) != (p.v, p.h) else plane
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3, uint8."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        y, cb, cr = planes
        y = y.astype(np.int16)
        red, blue, green_r, green_b = _chroma()
        return np.stack([y + red[cr], y - green_r[cr] - green_b[cb], y + blue[cb]], -1).clip(0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that ``encode_bytes`` stored."""
        values = np.concatenate([p.blocks for p in self.parts.values()]).ravel()[: struct.unpack(">Q", self.comment)[0]]
        return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


@functools.cache
def _chroma() -> tuple[np.ndarray, ...]:
    """What red, blue and (subtracted) green take from each chroma value; the standard's constants."""
    v = np.arange(256) - 128
    return tuple(np.rint(k * v).astype(np.int16) for k in (1.402, 1.772, 0.714136, 0.344136))


def feature(rgb: np.ndarray) -> str:
    """Size, channel means (rounded down) and a checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64) // (rgb.size // 3)
    return f"{rgb.shape[1]}x{rgb.shape[0]};{';'.join(map(str, sums.tolist()))};{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


# Columns


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % BLOCK or BLOCK * (not raw))


def _mapped(df: DataFrame, value: str, schema: str, row, *kept: str) -> DataFrame:
    """doc_id, the columns ``kept``, of numbers, and what ``row`` gives for each ``value``."""
    kind = df.schema["doc_id"].dataType.simpleString()
    along = "".join(f"{c} long, " for c in kept)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = list(zip(*map(row, part.column(1).to_pylist())))
                fields = [x.split() for x in schema.split(", ")]
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                arrays = [part.column(0), *(part.column(c) for c in kept), *(pa.array(x, kinds[k]) for x, (_, k) in zip(made, fields))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *kept, *(n for n, _ in fields)])

    return df.select("doc_id", value, *kept).mapInArrow(run, f"doc_id {kind}, {along}{schema}")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the JPEG that holds the text's padded bytes) for every row of ``docs``."""

    def row(text):
        n, payload = padded(text)
        return n, encode_bytes(payload)

    return _mapped(docs, "text", "n_bytes long, media binary", row)


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, height, width and tensor (uint8, height x width x 3) for every row of ``media`` (doc_id, media)."""

    def row(data):
        if data is None:
            return None, None, None
        rgb = Decoder(data).rgb()
        return rgb.shape[0], rgb.shape[1], rgb.tobytes()

    return _mapped(media, column, "height int, width int, tensor binary", row)


def stored_digests(media: DataFrame) -> DataFrame:
    """Digests of the payload and the stored form, and a feature of the tensor, of each row of ``encode_media``."""

    def row(data):
        image = Decoder(data)
        back = image.payload()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(image.rgb())

    return _mapped(media, "media", "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row, "n_bytes")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as media in a table, read the table back, and give digests of both with a feature of the tensor.

    Media of text take about twice its bytes and compress well, so the table is written with zstandard. It is dropped
    once the digests are written; who wants to keep it writes ``encode_media``.
    """
    stored = materialize(encode_media(docs), "media", "zstd")
    found = materialize(stored_digests(stored), "media-digests")
    drop_tables(stored)
    return found
