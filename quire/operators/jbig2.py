"""JBIG2 images as PDF files embed them: pages of generic regions, coded arithmetically or as Group 4.

Symbol dictionaries, text, halftone and refinement regions raise: what they code isn't guessed. Black is 1 in the
format and 0 in the pixels that :func:`decode` gives.
"""

from __future__ import annotations

import numpy as np

from quire.operators import fax

#: Bytes of an image at most, and pixels of a side.
MAX_BYTES, MAX_SIDE = 50 * 1024 * 1024, 10_000
#: Estimates of the arithmetic coder: probability, next state after the likelier and the less likely symbol, and whether
#: the likelier symbol changes then. Fixed values.
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0),
    (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0),
    (0x2401, 23, 20, 0), (0x2201, 24, 21, 0), (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0),
    (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
#: Neighbours (dx, dy) of a pixel by template, the highest bit of its context first; A marks the places that a region may move. Fixed values.
A1, A2, A3, A4 = "A1", "A2", "A3", "A4"
TEMPLATES = (
    (A4, (-1, -2), (0, -2), (1, -2), A3, A2, (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), A1, (-4, 0), (-3, 0), (-2, 0), (-1, 0)),
    ((-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), A1, (-3, 0), (-2, 0), (-1, 0)),
    ((-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), A1, (-2, 0), (-1, 0)),
    ((-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), A1, (-4, 0), (-3, 0), (-2, 0), (-1, 0)),
)
#: Contexts of the bit that says a row is like the one above.
LIKE_ABOVE = (0x9B25, 0x0795, 0x00E5, 0x0195)


class Jbig2Error(ValueError):
    pass


class Arithmetic:
    """The decoder of adaptive binary arithmetic codes; ``contexts`` hold 2 * state + likelier symbol."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.a = data, at, 0x8000
        self.c, self.left = self._byte(at) << 16, 0
        self._read()
        self.c <<= 7
        self.left -= 7

    def _byte(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def _read(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:  # a marker: ones follow without end
                self.c += 0xFF00
                self.left = 8
            else:
                self.at += 1
                self.c += self._byte(self.at) << 9
                self.left = 7
        else:
            self.at += 1
            self.c += self._byte(self.at) << 8
            self.left = 8

    def bit(self, contexts: bytearray, which: int) -> int:
        state, likely = contexts[which] >> 1, contexts[which] & 1
        q, more, less, turn = STATES[state]
        self.a -= q
        if self.c >> 16 < q:
            out = likely if self.a < q else 1 - likely
            self.a, rare = q, out != likely
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return likely
            rare = self.a < q
            out = 1 - likely if rare else likely
        contexts[which] = 2 * less + (likely ^ turn) if rare else 2 * more + likely
        while not self.a & 0x8000:
            if not self.left:
                self._read()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.left -= 1
        return out


def generic(data: bytes, width: int, height: int, template: int, moved: list[tuple[int, int]], typical: bool) -> np.ndarray:
    """A region of 0 and 1, each pixel decoded in the context of those before it."""
    coder, contexts = Arithmetic(data), bytearray(1 << 16)
    places = [moved[int(p[1]) - 1] if isinstance(p, str) else p for p in TEMPLATES[template]]
    if any(dy > 0 or dy == 0 and dx >= 0 or abs(dx) > 128 or dy < -128 for dx, dy in places):
        raise Jbig2Error("a context that isn't decoded yet")
    pad = max(4, *(abs(dx) for dx, _ in places))
    blank = bytearray(width + 2 * pad)
    rows: list[bytearray] = []
    like = 0
    for y in range(height):
        if typical:
            like ^= coder.bit(contexts, LIKE_ABOVE[template])
            if like:
                rows.append(bytearray(rows[-1]) if rows else bytearray(blank))
                continue
        row = bytearray(blank)
        rows.append(row)
        near = [(rows[y + dy] if y + dy >= 0 else blank, dx + pad) for dx, dy in places]
        bit = coder.bit
        for x in range(width):
            context = 0
            for line, dx in near:
                context = context << 1 | line[x + dx]
            row[x + pad] = bit(contexts, context)
    return np.array([np.frombuffer(r, np.uint8)[pad : pad + width] for r in rows], np.uint8).reshape(height, width)


def _segments(data: bytes) -> list[tuple[int, bytes]]:
    """(type, data) of the segments of an embedded stream."""
    out, at = [], 0
    while at + 11 <= len(data):
        number, flags = int.from_bytes(data[at : at + 4]), data[at + 4]
        count = data[at + 5] >> 5
        at += 5
        if count == 7:
            count = int.from_bytes(data[at : at + 4]) & 0x1FFFFFFF
            at += 4 + (count + 8) // 8
        else:
            at += 1
        at += count * (1 if number <= 256 else 2 if number <= 65536 else 4) + (4 if flags & 64 else 1)
        size = int.from_bytes(data[at : at + 4])
        at += 4
        if size == 0xFFFFFFFF:  # an immediate region that ends with its data
            size = len(data) - at
        out.append((flags & 63, data[at : at + size]))
        at += size
    return out


def _region(body: bytes) -> tuple[np.ndarray, int, int, int]:
    """(pixels, x, y, how they are combined) of a generic region segment."""
    width, height, x, y = (int.from_bytes(body[i : i + 4]) for i in (0, 4, 8, 12))
    combine, flags, at = body[16] & 7, body[17], 18
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise Jbig2Error(f"unusable size: {width}x{height}")
    template = flags >> 1 & 3
    if flags & 1:
        return (fax.decode(body[at:], width, height, -1, black_is_1=True) == 0).astype(np.uint8), x, y, combine
    count = 4 if template == 0 else 1
    signed = [b - 256 if b > 127 else b for b in body[at : at + 2 * count]]
    moved = list(zip(signed[::2], signed[1::2], strict=True))
    if len(moved) < count:
        raise Jbig2Error("broken region")
    return generic(body[at + 2 * count :], width, height, template, moved, bool(flags & 8)), x, y, combine


def decode(data: bytes, width: int, height: int, shared: bytes = b"") -> np.ndarray:
    """Pixels (0 black, 255 white) of an embedded image, ``shared`` being its globals."""
    if len(data) > MAX_BYTES or len(shared) > MAX_BYTES:
        raise Jbig2Error(f"image too large: {len(data)} bytes")
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise Jbig2Error(f"unusable size: {width}x{height}")
    page, regions = np.zeros((height, width), np.uint8), 0
    try:
        for kind, body in _segments(shared) + _segments(data):
            if kind == 48:  # the page: its flags hold the colour that it starts with
                page[:] = body[16] >> 2 & 1
            elif kind in (38, 39):
                made, x, y, combine = _region(body)
                regions += 1
                made = made[: max(0, height - y), : max(0, width - x)]
                under = page[y : y + made.shape[0], x : x + made.shape[1]]
                under[:] = (under | made, under & made, under ^ made, 1 - (under ^ made), made)[min(combine, 4)]
            elif kind not in (49, 50, 51, 52, 62):
                raise Jbig2Error(f"unsupported segment: {kind}")
    except IndexError as e:
        raise Jbig2Error(f"broken image: {e}") from e
    if not regions:
        raise Jbig2Error("no image data")
    return np.where(page == 1, 0, 255).astype(np.uint8)
