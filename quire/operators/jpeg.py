"""JPEG images to grey pixels: baseline, extended and progressive Huffman coding, 8 bits a sample.

:func:`decode` reads the coefficients of every component into one array each, then turns all blocks of a
component into samples by two matrix products. Arithmetic coding, lossless and hierarchical frames raise.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np

#: Pixels of an image at most, whatever size its header claims.
MAX_PIXELS = 256 * 1024 * 1024
#: The order in which a block's coefficients are stored: along its diagonals, up and down in turn.
ORDER = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
ZIGZAG = [8 * y + x for y, x in ORDER]
#: Weights of red, green and blue in a grey value. Fixed values.
LUMA = (0.2126, 0.7152, 0.0722)
#: The inverse cosine transform of 8 values.
COSINES = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


class JpegError(ValueError):
    pass


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    columns: int = 0  # blocks of a row and rows of blocks, filled up to whole units
    rows: int = 0
    values: array = field(default_factory=lambda: array("h"))
    dc: int = 0


class Bits:
    """Bits of one restart interval, most significant first; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        if self.at > len(self.data) + 4096:
            raise JpegError("data ends early")
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(part.ljust(6, b"\0"))
        self.n += 48

    def take(self, count: int) -> int:
        if not count:
            return 0
        if self.n < count:
            self.fill()
        self.n -= count
        return self.held >> self.n & (1 << count) - 1

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        entry = table[self.held >> (self.n - 16) & 0xFFFF]
        if not entry:
            raise JpegError("unknown code")
        self.n -= entry >> 8
        return entry & 255

    def signed(self, size: int) -> int:
        """A value of ``size`` bits; those that begin with 0 are negative."""
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the code that they begin with, as 256 * length + symbol; 0 for none."""
    table = np.zeros(1 << 16, np.int64)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first >= 1 << 16:
                raise JpegError("broken code table")
            table[first : first + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


class Scan:
    """What one scan adds to the coefficients of its components."""

    def __init__(self, bits: Bits, low: int, high: int, before: int, shift: int, progressive: bool) -> None:
        self.low, self.high, self.before, self.shift, self.progressive = low, high, before, shift, progressive
        self.restart(bits)

    def restart(self, bits: Bits) -> None:
        self.bits, self.run = bits, 0

    def block(self, c: Component, at: int, dc: list[int], ac: list[int]) -> None:
        if not self.progressive:
            self._first(c, at, dc)
            self._coefficients(c, at, ac, 1)
        elif self.low == 0:
            if self.before:
                c.values[at] |= self.bits.take(1) << self.shift
            else:
                self._first(c, at, dc)
        elif self.before:
            self._refine(c, at, ac)
        else:
            self._coefficients(c, at, ac, self.low)

    def _first(self, c: Component, at: int, dc: list[int]) -> None:
        size = self.bits.symbol(dc)
        c.dc += self.bits.signed(min(size, 15))
        c.values[at] = max(-32768, min(32767, c.dc << self.shift))

    def _coefficients(self, c: Component, at: int, ac: list[int], k: int) -> None:
        if self.run:
            self.run -= 1
            return
        bits, values, high, shift = self.bits, c.values, self.high, self.shift
        while k <= high:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                if k > 63:
                    raise JpegError("too many coefficients")
                values[at + ZIGZAG[k]] = max(-32768, min(32767, bits.signed(size) << shift))
                k += 1
            elif zeros == 15:
                k += 16
            else:  # this block ends, and so many after it
                self.run = (1 << zeros) - 1 + bits.take(zeros)
                return

    def _refine(self, c: Component, at: int, ac: list[int]) -> None:
        """One more bit of the coefficients that are known, and new ones of this bit's size."""
        bits, values, k, step = self.bits, c.values, self.low, 1 << self.shift
        if not self.run:
            while k <= self.high:
                s = bits.symbol(ac)
                zeros, new = s >> 4, 0
                if s & 15:
                    new = step if bits.take(1) else -step
                elif zeros < 15:
                    self.run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= self.high:
                    place = at + ZIGZAG[k]
                    k += 1
                    if values[place]:
                        self._sharpen(values, place, step)
                    elif zeros:
                        zeros -= 1
                    else:
                        values[place] = new
                        break
        if self.run:
            while k <= self.high:
                place = at + ZIGZAG[k]
                if values[place]:
                    self._sharpen(values, place, step)
                k += 1
            self.run -= 1

    def _sharpen(self, values: array, place: int, step: int) -> None:
        if self.bits.take(1) and not abs(values[place]) & step:
            values[place] += step if values[place] > 0 else -step


class Image:
    def __init__(self) -> None:
        self.width = self.height = self.interval = 0
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], list[int]] = {}
        self.progressive, self.transform = False, None

    def frame(self, body: bytes, progressive: bool) -> None:
        if body[0] != 8:
            raise JpegError(f"unsupported precision: {body[0]}")
        self.height, self.width, n = int.from_bytes(body[1:3]), int.from_bytes(body[3:5]), body[5]
        if not self.width or not self.height or self.width * self.height > MAX_PIXELS:
            raise JpegError(f"unusable size: {self.width}x{self.height}")
        self.progressive = progressive
        self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        if n not in (1, 3, 4) or any(not 1 <= x <= 4 for c in self.components for x in (c.across, c.down)):
            raise JpegError("unsupported components")
        self.across, self.down = max(c.across for c in self.components), max(c.down for c in self.components)
        for c in self.components:
            c.columns = -(-self.width // (8 * self.across)) * c.across
            c.rows = -(-self.height // (8 * self.down)) * c.down
            c.values = array("h", bytes(2 * 64 * c.columns * c.rows))

    def scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [(next(c for c in self.components if c.number == body[i]), body[i + 1]) for i in range(1, 1 + 2 * n, 2)]
        low, high, bits = body[1 + 2 * n : 4 + 2 * n]
        if not self.progressive:
            low, high, bits = 0, 63, 0
        if low > high or high > 63:
            raise JpegError("broken scan")
        pieces = _intervals(data)
        scan = Scan(Bits(pieces[0]), low, high, bits >> 4, bits & 15, self.progressive)
        tables = [(self.codes.get((0, t >> 4), []), self.codes.get((1, t & 15), [])) for _, t in parts]
        if n == 1:  # only the blocks that the image has
            c = parts[0][0]
            wide, tall = (-(-side * f // (8 * most)) for side, f, most in ((self.width, c.across, self.across), (self.height, c.down, self.down)))
            units = [[(0, 64 * (y * c.columns + x))] for y in range(tall) for x in range(wide)]
        else:
            wide, tall = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
            units = ([(i, 64 * ((v * c.down + y) * c.columns + u * c.across + x)) for i, (c, _) in enumerate(parts) for y in range(c.down) for x in range(c.across)] for v in range(tall) for u in range(wide))
        for c, _ in parts:
            c.dc = 0
        nth = 0
        for done, unit in enumerate(units):
            if self.interval and done and done % self.interval == 0:
                nth += 1
                scan.restart(Bits(pieces[nth] if nth < len(pieces) else b""))
                for c, _ in parts:
                    c.dc = 0
            for i, at in unit:
                scan.block(parts[i][0], at, *tables[i])

    def plane(self, c: Component) -> np.ndarray:
        if c.table not in self.quant:
            raise JpegError("no quantisation table")
        blocks = np.frombuffer(c.values, np.int16).reshape(-1, 8, 8) * self.quant[c.table].reshape(8, 8)
        samples = COSINES @ blocks @ COSINES.T + 128
        samples = samples.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)
        samples = np.clip(np.round(samples), 0, 255)
        if (c.across, c.down) != (self.across, self.down):
            rows, columns = np.arange(self.height) * c.down // self.down, np.arange(self.width) * c.across // self.across
            return samples[np.ix_(rows, columns)]
        return samples[: self.height, : self.width]

    def grey(self) -> np.ndarray:
        planes = [self.plane(c) for c in self.components]
        if len(planes) == 1:
            return planes[0].astype(np.uint8)
        y, b, r = planes[:3]
        if self.transform != 0:  # else the planes are red, green and blue
            b, r = b - 128, r - 128
            y, b, r = y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b
        red, green, blue = (np.clip(np.round(p), 0, 255) for p in (y, b, r))
        if len(planes) == 4:  # inks, stored inverted
            red, green, blue = (p * planes[3] / 255 for p in (red, green, blue))
        return np.clip(LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue, 0, 255).astype(np.uint8)


def _intervals(data: bytes) -> list[bytes]:
    """The restart intervals of coded data, up to the next other marker."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]]
        kind = data[at + 1]
        if kind in (0, 255):
            at += 2 if kind == 0 else 1
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        else:
            return [*out, data[start:at]]


def decode(data: bytes) -> np.ndarray:
    """Grey pixels (height, width) of a JPEG file; broken ones raise :class:`JpegError`."""
    try:
        return _decoded(data)
    except (IndexError, StopIteration, OverflowError) as e:
        raise JpegError(f"broken image: {e}") from e


def _decoded(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG image")
    image, at, scans = Image(), 2, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:  # coded data that has been read, or filling
            at = data.find(b"\xff", at)
            if at < 0:
                break
            continue
        kind = data[at + 1]
        if kind in (0, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4])]
        at += 4 + len(body)
        if kind in (0xC0, 0xC1, 0xC2):
            image.frame(body, kind == 0xC2)
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise JpegError(f"unsupported frame: {kind:02X}")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                image.codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                table = np.zeros(64)
                for i, place in enumerate(ZIGZAG):
                    table[place] = int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide])
                image.quant[body[0] & 15] = table
                body = body[1 + 64 * wide :]
        elif kind == 0xDD:
            image.interval = int.from_bytes(body[:2])
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            image.transform = body[11]
        elif kind == 0xDA:
            if not image.components:
                raise JpegError("a scan before its frame")
            image.scan(body, data[at:])
            scans += 1
    if not scans:
        raise JpegError("no image data")
    if len(image.components) == 4 and image.transform is None:
        image.transform = 0
    return image.grey()
