"""CCITT T.4 and T.6 coding of bitonal pages, in both directions.

A row is the list of places where its colour changes, beginning with white; so a page costs as many
steps as it has changes, and rows become pixels in one numpy assignment a run.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np

MAX_BYTES, MAX_SIDE = 100 * 1024 * 1024, 10_000
LOOK = 13

# Fixed values of ITU-T T.4: the codes of runs 0 to 63, then of 64, 128, ... 1728, then (both colours) of 1792, ... 2560.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
LONGER = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
PASS, HORIZONTAL, END_OF_LINE = "0001", "001", "000000000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}


@lru_cache(maxsize=2)
def run_codes(black: int) -> dict[int, str]:
    codes = (BLACK if black else WHITE).split() + LONGER.split()
    return {i if i < 64 else (i - 63) * 64: c for i, c in enumerate(codes)}


@lru_cache(maxsize=3)
def _lookup(kind: int) -> list[tuple[int, object] | None]:
    """What each LOOK bits begin with: (length, run) for colours 0 and 1, (length, mode) for 2."""
    codes = {PASS: "pass", HORIZONTAL: "horizontal"} | {c: d for d, c in VERTICAL.items()} if kind == 2 else {c: n for n, c in run_codes(kind).items()}
    table: list[tuple[int, object] | None] = [None] * (1 << LOOK)
    for code, meaning in codes.items():
        free = LOOK - len(code)
        first = int(code, 2) << free
        table[first : first + (1 << free)] = [(len(code), meaning)] * (1 << free)
    return table


def changes(row: np.ndarray) -> list[int]:
    """Places where a row of booleans (true: black) changes colour, the first from white."""
    return np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)).tolist()


def _run(n: int, black: int) -> str:
    codes, out = run_codes(black), ""
    while n > 2560:
        out, n = out + codes[2560], n - 2560
    if n >= 64:
        out, n = out + codes[n // 64 * 64], n % 64
    return out + codes[n]


def _reference(above: list[int], at: int, colour: int, width: int) -> tuple[int, int]:
    """The next two changes of the row above, the first being one away from ``colour``."""
    i = bisect_right(above, at)
    i += (i & 1) != colour
    return (above[i] if i < len(above) else width), (above[i + 1] if i + 1 < len(above) else width)


def _two_dimensional(row: list[int], above: list[int], width: int) -> str:
    at, colour, i, out = -1, 0, 0, []
    while at < width:
        a1 = row[i] if i < len(row) else width
        b1, b2 = _reference(above, at, colour, width)
        if b2 < a1:
            out.append(PASS)
            at = b2
        elif abs(a1 - b1) <= 3:
            out.append(VERTICAL[a1 - b1])
            at, colour, i = a1, 1 - colour, i + 1
        else:
            a2 = row[i + 1] if i + 1 < len(row) else width
            out += [HORIZONTAL, _run(a1 - max(at, 0), colour), _run(a2 - a1, 1 - colour)]
            at, i = a2, i + 2
    return "".join(out)


def _one_dimensional(row: list[int], width: int) -> str:
    ends = [0, *row, width]
    return "".join(_run(b - a, i & 1) for i, (a, b) in enumerate(zip(ends, ends[1:])))


def _bytes(rows: list[str]) -> bytes:
    bits = np.frombuffer("".join(rows).encode(), np.uint8) - ord("0")
    return np.packbits(bits).tobytes()


def encode(black: np.ndarray, k: int = -1) -> bytes:
    """A page of booleans (true: black) as Group 4 (k < 0), or Group 3 in one dimension (k = 0)."""
    height, width = black.shape
    if max(height, width) > 0xFFFF:
        raise ValueError(f"CCITT page of {width}x{height} exceeds 16 bits")
    above, rows = [], []
    for line in black:
        row = changes(line)
        rows.append(_two_dimensional(row, above, width) if k < 0 else _one_dimensional(row, width))
        above = row
    return _bytes([*rows, END_OF_LINE * 2] if k < 0 else rows)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5]) >> (40 - (self.at & 7) - n)) & ((1 << n) - 1)

    def take(self, kind: int) -> object:
        hit = _lookup(kind)[self.peek(LOOK)]
        if hit is None or self.at + hit[0] > self.size:
            raise ValueError("CCITT decode: no code at bit %d" % self.at)
        self.at += hit[0]
        return hit[1]

    def run(self, colour: int) -> int:
        total = part = self.take(colour)
        while part >= 64:
            part = self.take(colour)
            total += part
        return total

    def line_ends(self) -> int:
        """Passes end-of-line marks with their fill; how many there were."""
        n = 0
        while self.at < self.size:
            here = self.at
            while self.at < self.size and not self.peek(12):
                self.at += 1
            if self.peek(12) != 1 or self.at >= self.size:
                self.at = here
                break
            self.at, n = self.at + 12, n + 1
        return n


def _turn(row: list[int], at: int, width: int) -> None:
    """The colour changes at ``at``; two changes at one place cancel."""
    if row and row[-1] == at:
        row.pop()
    elif at < width:
        row.append(at)


def _coded_row(bits: _Bits, above: list[int], width: int, flat: bool) -> list[int]:
    row: list[int] = []
    at, colour = -1, 0
    while at < width:
        mode = "horizontal" if flat else bits.take(2)
        if mode == "pass":
            at = _reference(above, at, colour, width)[1]
            continue
        if mode == "horizontal":
            for turned in (colour,) if flat else (colour, 1 - colour):
                at = min(max(at, 0) + bits.run(turned), width)
                _turn(row, at, width)
            colour = 1 - colour if flat else colour
            continue
        to = min(_reference(above, at, colour, width)[0] + mode, width)
        if to < max(at, 0):
            raise ValueError("CCITT decode: a row runs backwards")
        at, colour = to, 1 - colour
        _turn(row, at, width)
    return row


def decode(data: bytes, width: int, height: int, k: int = -1, columns: int | None = None, black_is_1: bool = False, byte_align: bool = False) -> np.ndarray:
    """Grey pixels, 0 and 255, of a CCITT stream: k < 0 Group 4, 0 Group 3, above 0 Group 3 in two dimensions.

    With ``black_is_1`` black pixels are 0, else 255. Runs beyond a row's end stop there; rows that
    are wider than the page are cut to it. What holds too few rows, or no valid code, raises.
    """
    if len(data) > MAX_BYTES:
        raise ValueError(f"CCITT stream too large: {len(data)} bytes (max {MAX_BYTES})")
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"invalid CCITT image dimensions: {width}x{height}")
    wide = max(columns or width, width)
    out = np.full((height, width), 255 if black_is_1 else 0, np.uint8)
    bits, above = _Bits(data), []
    for y in range(height):
        if byte_align:
            bits.at = (bits.at + 7) // 8 * 8
        ends = bits.line_ends()
        if bits.at >= bits.size or ends > 1:
            raise ValueError(f"CCITT decode: {y} of {height} rows")
        flat = k == 0
        if k > 0:
            flat, bits.at = bool(bits.peek(1)), bits.at + 1
        above = _coded_row(bits, above, wide, flat)
        for a, b in zip(above[::2], [*above[1::2], wide]):
            out[y, a:b] = 0 if black_is_1 else 255
    return out
