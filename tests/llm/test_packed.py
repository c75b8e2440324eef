import numpy as np
import pytest

from almanac.llm import packed


@pytest.mark.parametrize("kind", ["<u4", "<u8"])
@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_squeeze_round_trip(kind, n):
    values = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
    assert np.array_equal(packed.unsqueeze(packed.squeeze(values, kind), kind), values)


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_sorted_round_trip(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
    assert np.array_equal(packed.unsqueeze_sorted(packed.squeeze_sorted(keys)), keys)


@pytest.mark.parametrize("bits", [40, 64])
def test_ranges_split_the_key_space_evenly(bits):
    edges = packed.range_edges(8, bits)
    assert len(edges) == 7 and len(set(np.diff(edges))) == 1
