from __future__ import annotations

import numpy as np
import pytest

from quire.operators import fax


@pytest.mark.parametrize("black", [0, 1])
def test_codes_are_free_of_prefixes(black):
    codes = sorted(fax.run_codes(black).values())
    assert len(codes) == len(set(codes)) == 104
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert max(map(len, codes)) <= fax.LOOK


@pytest.mark.parametrize("k", [-1, 0])
@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (40, 64), (5, 2600), (2, 9000)])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_round_trip(k, shape, share):
    rng = np.random.default_rng(7)
    black = rng.random(shape) < share
    if shape[0] > 2:
        black[2] = black[1]  # a row like the one above, then a shifted one
        black[-1] = np.roll(black[1], 2)
    page = fax.decode(fax.encode(black, k), shape[1], shape[0], k, black_is_1=True)
    assert (page == np.where(black, 0, 255)).all()


def test_long_runs_take_several_codes():
    black = np.zeros((2, 9000), bool)
    black[1, 100:8999] = True
    for k in (-1, 0):
        assert (fax.decode(fax.encode(black, k), 9000, 2, k, black_is_1=True) == np.where(black, 0, 255)).all()


@pytest.mark.parametrize(("data", "k", "want"), [(b"\x80", -1, 255), (b"\xb0", 0, 255), (b"\x35\x30", 0, 0)])
def test_known_streams(data, k, want):
    assert fax.decode(data, 4, 1, k, black_is_1=True).tolist() == [[want] * 4]
    assert fax.decode(data, 4, 1, k).tolist() == [[255 - want] * 4]


def test_two_dimensional_group_3():
    rows = fax.END_OF_LINE + "1" + fax._one_dimensional([2, 5], 8) + fax.END_OF_LINE + "0" + fax._two_dimensional([3, 5], [2, 5], 8)
    got = fax.decode(fax._bytes([rows]), 8, 2, 4, black_is_1=True)
    assert got.tolist() == [[255, 255, 0, 0, 0, 255, 255, 255], [255, 255, 255, 0, 0, 255, 255, 255]]


@pytest.mark.parametrize(("data", "width", "height"), [(b"", 4, 1), (b"\x80", 0, 1), (b"\x80", 4, 10_001), (b"\x80", 4, 200), (b"\x00\x00\x00", 4, 1)])
def test_bad_streams_raise(data, width, height):
    with pytest.raises(ValueError, match="CCITT"):
        fax.decode(data, width, height)


def test_too_large(monkeypatch):
    monkeypatch.setattr(fax, "MAX_BYTES", 3)
    with pytest.raises(ValueError, match="CCITT stream too large"):
        fax.decode(b"\x80" * 4, 4, 1)
