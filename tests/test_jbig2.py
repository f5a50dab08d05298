from __future__ import annotations

import numpy as np
import pytest

from quire.operators import fax, jbig2, pdf


def test_the_published_sequence():
    """The arithmetic coder's own test: 256 bits in one context."""
    coded = bytes.fromhex("84C73BFCE1A14304022000 00410DBB86F4317FFF88FF37471ADB6ADFFFAC".replace(" ", ""))
    plain = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
    coder, contexts = jbig2.Arithmetic(coded), bytearray(1)
    bits = [coder.bit(contexts, 0) for _ in range(8 * len(plain))]
    assert np.packbits(bits).tobytes() == plain


class Encoder:
    """The coder's other direction, for tests."""

    def __init__(self):
        self.a, self.c, self.left, self.out = 0x8000, 0, 12, bytearray([0])

    def put(self, contexts, which, bit):
        state, likely = contexts[which] >> 1, contexts[which] & 1
        q, more, less, turn = jbig2.STATES[state]
        self.a -= q
        if bit == likely:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            contexts[which] = 2 * more + likely
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            contexts[which] = 2 * less + (likely ^ turn)
        while not self.a & 0x8000:
            self.a, self.c, self.left = self.a << 1, self.c << 1, self.left - 1
            if not self.left:
                self.byte()

    def byte(self):
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c, self.left = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19)
            self.c, self.left = self.c & 0x7FFFF, 8

    def end(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.left
            self.byte()
        return bytes(self.out[1:]) + b"\xff\xac"


MOVED = {0: [(3, -1), (-3, -1), (2, -2), (-2, -2)], 1: [(3, -1)], 2: [(2, -1)], 3: [(2, -1)]}


def coded(page: np.ndarray, template: int, typical: bool) -> bytes:
    """A generic region segment's data for a page of 0 and 1."""
    h, w = page.shape
    coder, contexts, like = Encoder(), bytearray(1 << 16), 0
    places = [MOVED[template][int(p[1]) - 1] if isinstance(p, str) else p for p in jbig2.TEMPLATES[template]]
    for y in range(h):
        if typical:
            same = int((page[y] == (page[y - 1] if y else 0)).all())
            coder.put(contexts, jbig2.LIKE_ABOVE[template], same ^ like)
            like = same
            if same:
                continue
        for x in range(w):
            context = 0
            for dx, dy in places:
                inside = 0 <= x + dx < w and 0 <= y + dy
                context = context << 1 | (int(page[y + dy, x + dx]) if inside else 0)
            coder.put(contexts, context, int(page[y, x]))
    sizes = b"".join(n.to_bytes(4, "big") for n in (w, h, 0, 0)) + b"\0"
    return sizes + bytes([template << 1 | typical << 3]) + bytes(b & 255 for p in MOVED[template] for b in p) + coder.end()


def segment(number: int, kind: int, body: bytes) -> bytes:
    return number.to_bytes(4, "big") + bytes([kind, 0, 1]) + len(body).to_bytes(4, "big") + body


def file(page: np.ndarray, region: bytes) -> bytes:
    h, w = page.shape
    info = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(8) + b"\0\0\0"
    return segment(0, 48, info) + segment(1, 38, region) + segment(2, 49, b"")


def sheet(h: int = 30, w: int = 45) -> np.ndarray:
    rng = np.random.default_rng(3)
    page = np.kron(rng.random((h // 5, w // 5)) < 0.4, np.ones((5, 5))).astype(np.uint8)
    page[7, 9] ^= 1
    return page


@pytest.mark.parametrize("typical", [False, True])
@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_generic_regions(template, typical):
    page = sheet()
    got = jbig2.decode(file(page, coded(page, template, typical)), page.shape[1], page.shape[0])
    assert (got == np.where(page == 1, 0, 255)).all()


def test_group_4_regions_and_combination():
    page = sheet()
    sizes = b"".join(n.to_bytes(4, "big") for n in (45, 30, 0, 0))
    body = fax.encode(page == 1)
    one = segment(1, 38, sizes + b"\0\x01" + body)
    assert (jbig2.decode(one, 45, 30) == np.where(page == 1, 0, 255)).all()
    twice = one + segment(2, 38, sizes + b"\x02\x01" + body)  # exclusive or with itself
    assert (jbig2.decode(twice, 45, 30) == 255).all()


def test_what_is_not_built_raises():
    page = sheet()
    data = file(page, coded(page, 0, False))
    for bad in (segment(0, 0, b"x"), segment(0, 6, bytes(40)), data[:40]):
        if bad == data[:40]:
            with pytest.raises(ValueError):
                jbig2.decode(bad, 45, 30)
        else:
            with pytest.raises(jbig2.Jbig2Error, match="unsupported segment"):
                jbig2.decode(bad, 45, 30)
    with pytest.raises(jbig2.Jbig2Error, match="unusable size"):
        jbig2.decode(data, 20_000, 30)


def test_a_page_with_such_an_image():
    page = sheet()
    image = pdf.Stream({"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Image"), "Width": 45, "Height": 30, "ColorSpace": pdf.Name("DeviceGray"), "BitsPerComponent": 1, "Filter": pdf.Name("JBIG2Decode")}, file(page, coded(page, 0, True)))
    doc = pdf.load(pdf.save(pdf.new_document([(100, 150, image, b"")])))
    assert (pdf.pixels(doc, pdf.images(doc, doc.pages()[0][2])[0][2]) == np.where(page == 1, 0, 255)).all()
