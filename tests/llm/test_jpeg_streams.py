"""Progressive streams of a small encoder of the test's own, with the tables that most encoders write."""

import struct

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from almanac.llm import jpeg  # noqa: E402

# The standard's example tables for luminance.
DC_COUNTS, DC_VALUES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]
_HEAD = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 A1 08 23 42 B1 C1 15 52 D1 F0 24 33 62 72 82 09 0A 16 17 18 19 1A 25 26 27 28 29 2A"
AC_VALUES = [int(x, 16) for x in _HEAD.split()] + [r << 4 | s for r, first in ((3, 4), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2), (14, 1), (15, 1)) for s in range(first, 11)]


def _codes(counts, values):
    out, code, at = {}, 0, 0
    for length, many in enumerate(counts, 1):
        for _ in range(many):
            out[values[at]] = format(code, f"0{length}b")
            code, at = code + 1, at + 1
        code <<= 1
    return out


DC, AC = _codes(DC_COUNTS, DC_VALUES), _codes(AC_COUNTS, AC_VALUES)


def _magnitude(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def _dc_first(blocks, low):
    out, last = "", 0
    for b in blocks:
        v = int(b[0]) >> low
        n, bits = _magnitude(v - last)
        out, last = out + DC[n] + bits, v
    return out


def _dc_more(blocks, low):
    return "".join(str(int(b[0]) >> low & 1) for b in blocks)


def _ac_first(blocks, first, last, low):
    out = ""
    for b in blocks:
        run = 0
        for k in range(first, last + 1):
            v = int(np.sign(b[k])) * (abs(int(b[k])) >> low)
            if not v:
                run += 1
                continue
            while run > 15:
                out, run = out + AC[0xF0], run - 16
            n, bits = _magnitude(v)
            out, run = out + AC[run << 4 | n] + bits, 0
        out += AC[0] if run else ""
    return out


def _ac_more(blocks, first, last, low):
    out = ""
    for b in blocks:
        size = [abs(int(x)) >> low for x in b]
        new = max((k for k in range(first, last + 1) if size[k] == 1), default=-1)
        run, kept = 0, ""
        for k in range(first, last + 1):
            if not size[k]:
                run += 1
                continue
            while run > 15 and k <= new:
                out, run, kept = out + AC[0xF0] + kept, run - 16, ""
            if size[k] > 1:
                kept += str(size[k] & 1)
                continue
            out, run, kept = out + AC[run << 4 | 1] + ("1" if b[k] > 0 else "0") + kept, 0, ""
        out += AC[0] + kept if run or kept else ""
    return out


def _segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stream(blocks, across, down):
    def scan(first, last, high, low, bits):
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        return _segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + data

    out = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\1\x11\0")
    out += _segment(0xC4, bytes([0, *DC_COUNTS, *DC_VALUES])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES]))
    out += scan(0, 0, 0, 1, _dc_first(blocks, 1)) + scan(1, 5, 0, 2, _ac_first(blocks, 1, 5, 2)) + scan(6, 63, 0, 2, _ac_first(blocks, 6, 63, 2))
    out += scan(1, 63, 2, 1, _ac_more(blocks, 1, 63, 1)) + scan(0, 0, 1, 0, _dc_more(blocks, 0)) + scan(1, 63, 1, 0, _ac_more(blocks, 1, 63, 0))
    return out + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_scans_with_common_tables_accumulate(seed):
    r = np.random.default_rng(seed)
    across, down = r.integers(1, 5, 2).tolist()
    blocks = np.where(r.random((across * down, 64)) < r.choice([0.05, 0.3, 0.9]), r.integers(-200, 201, (across * down, 64)), 0)
    blocks[:, 0] = r.integers(-900, 901, across * down)
    image = jpeg.Decoder(_stream(blocks, across, down))
    (part,) = image.parts.values()
    assert (np.asarray(part.blocks).reshape(-1, 64)[: across * down] == blocks).all()
    rgb = image.rgb()
    assert rgb.shape == (8 * down, 8 * across, 3)
    grid = np.zeros((8 * down, 8 * across))
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(0.5), 1.0) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    for i, b in enumerate(blocks):  # the inverse transform in floating point
        square = np.zeros(64)
        square[jpeg.ZIGZAG] = b
        y, x = divmod(i, across)
        grid[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
    assert np.abs(rgb[:, :, 0] - grid.clip(0, 255)).max() < 2
