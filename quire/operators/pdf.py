"""PDF files: objects, pages, images and text layers, read and written.

:func:`load` reads cross-reference tables and streams, object streams and Flate; a file whose tables are
broken is read by looking for its objects. Changes are made on the loaded objects and :func:`save`
writes them out anew. What goes over DataFrames is in :mod:`quire.operators.documents`.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np

from quire.operators import crypt, fax, jbig2, jpeg, raster

MAX_FILE, MAX_INFLATED = 512 * 1024 * 1024, 256 * 1024 * 1024
MAX_DEPTH = 64
#: The size that a page box's unreadable numbers stand for.
DEFAULT_BOX = (0.0, 0.0, 595.0, 842.0)
PRODUCER = "quire"

SPACE, DELIMITER = b"\0\t\n\f\r ", b"()<>[]{}/%"
GAP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
OBJECT = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
SHOWS_TEXT = {b"Tj", b"TJ", b"'", b'"'}


#: Metadata that claims PDF/A-2B. Fixed value.
XMP = '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" pdfaid:part="2" pdfaid:conformance="B"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'


class PdfError(ValueError):
    pass


class PasswordError(PdfError):
    """An encrypted file, and no password or a wrong one."""


#: What a damaged file may raise anywhere between its bytes and its pixels.
BROKEN = (EOFError, ValueError, KeyError, TypeError, IndexError, AttributeError, OverflowError, RecursionError)


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict[str, Any]
    data: bytes


class Operator(bytes):
    """A bare word: an operator of a content stream, or a keyword of the file."""


class Reader:
    """Objects from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references

    def gap(self) -> None:
        self.at = GAP.match(self.data, self.at).end()

    def one(self, depth: int = 0) -> Any:
        """The next object; an :class:`Operator` for a bare word; raises EOFError at the end."""
        if depth > MAX_DEPTH:
            raise PdfError("objects nested too deep")
        self.gap()
        d, at = self.data, self.at
        if at >= len(d):
            raise EOFError
        c = d[at : at + 1]
        if c == b"/":
            self.at = at + 1
            raw = self._word()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[at : at + 2] == b"<<":
            self.at = at + 2
            return self._dictionary(depth)
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at = at + 1
            return self._until(b"]", depth)
        if c in b"]{})>":
            self.at = at + 1
            return Operator(c)
        if self.references and (m := REFERENCE.match(d, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        word = self._word()
        if NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))

    def _word(self) -> bytes:
        m = WORD.match(self.data, self.at)
        self.at = m.end() if m else self.at
        return m[0] if m else b""

    def _until(self, close: bytes, depth: int) -> list:
        out = []
        while True:
            x = self.one(depth + 1)
            if type(x) is Operator and x == close:
                return out
            out.append(x)

    def _dictionary(self, depth: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            self.gap()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.one(depth + 1)
            if not isinstance(key, Name):
                raise PdfError("a dictionary's key is no name")
            out[str(key)] = self.one(depth + 1)

    def _string(self) -> bytes:
        d, at, level, out = self.data, self.at + 1, 1, []
        while at < len(d):
            c = d[at : at + 1]
            at += 1
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(d, at):
                    out.append(bytes([int(m[0], 8) & 255]))
                    at = m.end()
                elif m := re.compile(rb"\r\n|\r|\n").match(d, at):
                    at = m.end()
                else:
                    c = d[at : at + 1]
                    out.append(ESCAPES.get(c, c))
                    at += 1
                continue
            level += (c == b"(") - (c == b")")
            if not level:
                break
            out.append(c)
        self.at = at
        return b"".join(out)


def _integer(x: Any, otherwise: int = 0) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) else otherwise


def _number(x: Any, otherwise: float) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else otherwise


def inflated(data: bytes, most: int = MAX_INFLATED) -> bytes:
    try:
        z = zlib.decompressobj()
        out = z.decompress(data, most)
    except zlib.error as e:
        raise PdfError(f"flate: {e}") from e
    if z.unconsumed_tail:
        raise PdfError(f"flate stream of more than {most} bytes")
    return out


def unpredicted(data: bytes, columns: int) -> bytes:
    """Undoes the PNG row filters of a byte-wide table (what cross-reference streams use)."""
    rows, above = [], bytearray(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(columns):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                near = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + near) & 255
        rows.append(bytes(row))
        above = row
    return b"".join(rows)


@dataclass
class Document:
    objects: dict[int, Any] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)

    def get(self, x: Any) -> Any:
        """What a reference stands for; other objects are themselves."""
        for _ in range(MAX_DEPTH):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        return None

    def add(self, x: Any) -> Ref:
        number = max(self.objects, default=0) + 1
        self.objects[number] = x
        return Ref(number, 0)

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    @property
    def catalog(self) -> dict[str, Any] | None:
        root = self.get(self.trailer.get("Root"))
        return root if isinstance(root, dict) else None

    def pages(self) -> list[tuple[dict[str, Any], list[float] | None, dict | None]]:
        """(page, box, resources) in order; the box and resources of the nearest ancestor that has them."""
        out, seen = [], set()

        def walk(ref: Any, box: Any, resources: Any, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen or depth > MAX_DEPTH:
                return
            seen.add(id(node))
            box, resources = node.get("MediaBox", box), node.get("Resources", resources)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, box, resources, depth + 1)
            else:
                found = self.get(resources)
                out.append((node, self._box(box), found if isinstance(found, dict) else None))

        walk((self.catalog or {}).get("Pages"), None, None, 0)
        return out

    def _box(self, box: Any) -> list[float] | None:
        box = self.get(box)
        if not isinstance(box, list) or len(box) < 4:
            return None
        return [_number(self.get(x), d) for x, d in zip(box, DEFAULT_BOX)]

    def content(self, page: dict[str, Any]) -> bytes:
        """The page's content streams, those that can't be decoded left out."""
        parts = self.get(page.get("Contents"))
        out = []
        for part in parts if isinstance(parts, list) else [parts]:
            stream = self.get(part)
            if isinstance(stream, Stream):
                try:
                    out.append(self.decoded(stream))
                except BROKEN:
                    continue
        return b"\n".join(out)

    def filters(self, stream: Stream) -> list[str]:
        f = self.get(stream.entries.get("Filter"))
        return [str(self.get(x)) for x in (f if isinstance(f, list) else [] if f is None else [f])]

    def decoded(self, stream: Stream) -> bytes:
        data = stream.data
        for f in self.filters(stream):
            if f != "FlateDecode":
                raise PdfError(f"unsupported filter: {f}")
            data = inflated(data)
        parms = self.get(stream.entries.get("DecodeParms"))
        if isinstance(parms, dict) and _integer(parms.get("Predictor"), 1) >= 10:
            data = unpredicted(data, _integer(parms.get("Columns"), 1))
        return data


def _stream_or(doc: Document, data: bytes, at: int, lengths: bool = True) -> Any:
    """The object after ``n g obj`` at ``at``."""
    r = Reader(data, at)
    x = r.one()
    if not isinstance(x, dict):
        return x
    r.gap()
    if data[r.at : r.at + 6] != b"stream":
        return x
    start = r.at + 6
    start += 2 if data[start : start + 2] == b"\r\n" else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
    n = x.get("Length")
    if isinstance(n, Ref):
        m = OBJECT.match(data, doc.trailer.get("__at", {}).get(n.number, len(data))) if lengths else None
        n = Reader(data, m.end()).one() if m else None
    if not isinstance(n, int) or not GAP.match(data, start + n) or data[GAP.match(data, start + n).end() :][:9] != b"endstream":
        end = data.find(b"endstream", start)
        end = len(data) if end < 0 else end
        n = end - start - (2 if data[end - 2 : end] == b"\r\n" else 1 if data[end - 1 : end] in (b"\n", b"\r") else 0)
    return Stream(x, data[start : start + max(n, 0)])


def _table(data: bytes, at: int, places: dict[int, Any], trailer: dict[str, Any]) -> Any:
    """Reads one cross-reference section; the place of the one before it, or None."""
    r = Reader(data, at)
    r.gap()
    if data[r.at : r.at + 4] == b"xref":
        r.at += 4
        while isinstance(first := r.one(), int):
            for i in range(_integer(r.one())):
                r.gap()
                m = re.compile(rb"(\d{10}) (\d{5}) ([nf])").match(data, r.at)
                if not m:
                    raise PdfError("broken cross-reference table")
                r.at = m.end()
                if m[3] == b"n":
                    places.setdefault(first + i, int(m[1]))
        found = r.one() if first == b"trailer" else None
        if not isinstance(found, dict):
            raise PdfError("no trailer")
    else:
        m = OBJECT.match(data, r.at)
        stream = _stream_or(Document(), data, m.end(), lengths=False) if m else None
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise PdfError("no cross-reference section")
        found, body, widths = stream.entries, Document().decoded(stream), stream.entries["W"]
        index, row = found.get("Index") or [0, found.get("Size", 0)], 0
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                at, cells = row * sum(widths), []
                for w in widths:
                    cells.append(int.from_bytes(body[at : at + w]))
                    at += w
                kind = cells[0] if widths[0] else 1
                if kind == 1:
                    places.setdefault(number, cells[1])
                elif kind == 2:
                    places.setdefault(number, (cells[1], cells[2]))
                row += 1
    for key, value in found.items():
        trailer.setdefault(key, value)
    return found.get("Prev")


def _objects_of(doc: Document, container: Stream) -> dict[int, Any]:
    body = doc.decoded(container)
    head, out = Reader(body, references=False), {}
    pairs = [(head.one(), head.one()) for _ in range(_integer(container.entries.get("N")))]
    for number, offset in pairs:
        out[number] = Reader(body, _integer(container.entries.get("First")) + offset).one()
    return out


def _by_search(data: bytes) -> tuple[dict[int, Any], dict[str, Any]]:
    places = {int(m[1]): m.start() for m in OBJECT.finditer(data)}
    trailer: dict[str, Any] = {}
    for m in re.finditer(rb"trailer", data):
        try:
            found = Reader(data, m.end()).one()
        except BROKEN:
            continue
        trailer |= found if isinstance(found, dict) else {}
    return places, trailer


def load(data: bytes, password: str | None = None) -> Document:
    """Parses a file, an encrypted one with its password; a broken one raises PdfError, one that stays locked PasswordError."""
    if len(data) > MAX_FILE:
        raise PdfError(f"file too large: {len(data)} bytes (max {MAX_FILE})")
    if b"%PDF-" not in data[:1024]:
        raise PdfError("not a PDF file")
    try:
        start = re.search(rb"startxref\s+(\d+)", data[data.rfind(b"startxref") :])
        at, places, trailer, seen = int(start[1]) if start else None, {}, {}, set()
        if at is None:
            raise PdfError("no startxref")
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            at = _table(data, at, places, trailer)
        doc = _filled(data, places, trailer, password)
        if doc.catalog is None:
            raise PdfError("no catalog")
    except PasswordError:
        raise
    except BROKEN:
        places, trailer = _by_search(data)
        try:
            doc = _filled(data, places, trailer, password)
        except PasswordError:
            raise
        except BROKEN as e:
            raise PdfError(f"broken file: {e}") from e
        if doc.catalog is None:
            catalogs = [n for n, x in doc.objects.items() if isinstance(x, dict) and x.get("Type") == "Catalog"]
            if not catalogs:
                raise PdfError("no catalog") from None
            doc.trailer["Root"] = Ref(catalogs[-1], 0)
    return doc


def _unlocked(doc: Document, generations: dict[int, int], password: str | None) -> None:
    """Deciphers the objects of an encrypted file in place; objects within object streams come in the clear from those."""
    if password is None:
        raise PasswordError("password required")
    ref, first = doc.trailer.pop("Encrypt"), doc.get(doc.trailer.get("ID"))
    first = doc.get(first[0]) if isinstance(first, list) and first else b""

    def resolved(x: Any, depth: int = 0) -> Any:
        x = doc.get(x)
        return {k: resolved(v, depth + 1) for k, v in x.items()} if isinstance(x, dict) and depth < MAX_DEPTH else x

    try:
        security = crypt.unlock(resolved(ref), first if isinstance(first, bytes) else b"", password)
    except crypt.WrongPassword as e:
        raise PasswordError(str(e)) from e
    except BROKEN as e:
        raise PasswordError(f"broken encryption entries: {e}") from e

    def plain(x: Any, number: int, generation: int) -> Any:
        if type(x) is bytes:
            return security.string(x, number, generation)
        if isinstance(x, list):
            return [plain(y, number, generation) for y in x]
        if isinstance(x, dict):
            return {k: plain(v, number, generation) for k, v in x.items()}
        if not isinstance(x, Stream) or x.entries.get("Type") == "XRef":
            return x
        entries, filters = plain(x.entries, number, generation), doc.filters(x)
        clear = "Crypt" in filters or not security.metadata and x.entries.get("Type") == "Metadata"
        if "Crypt" in filters:
            entries["Filter"] = [Name(f) for f in filters if f != "Crypt"]
        return Stream(entries, x.data if clear else security.stream(x.data, number, generation))

    for number, x in doc.objects.items():
        if not (isinstance(ref, Ref) and number == ref.number):
            doc.objects[number] = plain(x, number, generations.get(number, 0))


def _filled(data: bytes, places: dict[int, Any], trailer: dict[str, Any], password: str | None) -> Document:
    generations: dict[int, int] = {}
    doc = Document(trailer=trailer | {"__at": {n: p for n, p in places.items() if isinstance(p, int)}})
    for number, place in places.items():
        if isinstance(place, int):
            m = OBJECT.match(data, GAP.match(data, place).end()) if place < len(data) else None
            if not m or int(m[1]) != number:
                raise PdfError(f"object {number} isn't where the table says")
            doc.objects[number], generations[number] = _stream_or(doc, data, m.end()), int(m[2])
    if doc.encrypted:
        _unlocked(doc, generations, password)
    wanted: dict[int, list[int]] = {}
    for number, place in places.items():
        if not isinstance(place, int):
            wanted.setdefault(place[0], []).append(number)
    searched = {n: [] for n, x in doc.objects.items() if isinstance(x, Stream) and x.entries.get("Type") == "ObjStm"}
    for container in wanted or searched:
        inner = _objects_of(doc, doc.objects[container])
        doc.objects |= {n: x for n, x in inner.items() if n in wanted[container]} if wanted else {n: x for n, x in inner.items() if n not in doc.objects}
    doc.trailer.pop("__at")
    return doc


def has_text(content: bytes) -> bool:
    """Whether a content stream shows text; stops at the first operator that does."""
    r = Reader(content, references=False)
    try:
        while True:
            x = r.one()
            if type(x) is Operator:
                if bytes(x) in SHOWS_TEXT:
                    return True
                if x == b"ID":  # an inline image: its bytes aren't operators
                    end = re.compile(rb"[\0\t\n\f\r ]EI(?![^\0\t\n\f\r ()<>\[\]{}/%])").search(content, r.at)
                    r.at = end.end() if end else len(content)
    except BROKEN:
        return False


def images(doc: Document, resources: dict | None) -> list[tuple[str, Any, Stream]]:
    """(name, reference or stream, image) of a page's image objects of some size, in the dictionary's order."""
    if resources is None:
        raise PdfError("no resources")
    found = doc.get(resources.get("XObject"))
    out = []
    for name, ref in (found if isinstance(found, dict) else {}).items():
        x = doc.get(ref)
        if isinstance(x, Stream) and x.entries.get("Subtype") == "Image" and all(_integer(doc.get(x.entries.get(s))) > 0 for s in ("Width", "Height")):
            out.append((name, ref, x))
    return out


def pixels(doc: Document, stream: Stream) -> np.ndarray:
    """Grey pixels of an image stream, by its first filter."""
    entries = {k: doc.get(v) for k, v in stream.entries.items()}
    width, height = entries["Width"], entries["Height"]
    bits, first = _integer(entries.get("BitsPerComponent"), 8), (doc.filters(stream) or [None])[0]
    if first == "CCITTFaxDecode":
        p = entries.get("DecodeParms")
        p = doc.get(p[0]) if isinstance(p, list) and p else p
        p = p if isinstance(p, dict) else {}
        return fax.decode(stream.data, width, height, _integer(p.get("K"), -1), _integer(p.get("Columns")) or None, p.get("BlackIs1") is True, p.get("EncodedByteAlign") is True)
    if first == "DCTDecode":
        return jpeg.decode(stream.data)
    if first == "JBIG2Decode":
        p = entries.get("DecodeParms")
        p = doc.get(p[0]) if isinstance(p, list) and p else p
        shared = doc.get(p.get("JBIG2Globals")) if isinstance(p, dict) else None
        return jbig2.decode(stream.data, width, height, doc.decoded(shared) if isinstance(shared, Stream) else b"")
    if first not in (None, "FlateDecode"):
        raise PdfError(f"unsupported image filter: {first}")
    page = raster.unpacked(stream.data, width, height, bits) if first is None else raster.inflate(stream.data, width, height, bits)
    decode = entries.get("Decode")
    turned = isinstance(decode, list) and len(decode) > 1 and _number(decode[0], 0) > _number(decode[1], 1)
    return 255 - page if entries.get("ImageMask") is True or turned else page


def image_stream(page: np.ndarray, codec: str = "flate", compat_k0: bool = False) -> Stream:
    """A page as an image: ``flate`` keeps its greys; ``ccitt`` its black (0) and other pixels, as Group 4.

    ``compat_k0`` labels Group 4 data as K 0, as old writers do; readers that heed K can't read it.
    """
    height, width = page.shape
    base = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name("DeviceGray")}
    if codec == "flate":
        return Stream(base | {"BitsPerComponent": 8, "Filter": Name("FlateDecode")}, raster.flate(page))
    if codec != "ccitt":
        raise PdfError(f"unknown codec: {codec}")
    parms = {"K": 0 if compat_k0 else -1, "Columns": width, "Rows": height, "BlackIs1": True}
    return Stream(base | {"BitsPerComponent": 1, "Filter": Name("CCITTFaxDecode"), "DecodeParms": parms, "Decode": [1, 0]}, fax.encode(page == 0))


def replace_image(doc: Document, resources: dict | None, stream: Stream) -> bool:
    """The first image that the page refers to becomes ``stream``; false where it has none."""
    if resources is None or not isinstance(doc.get(resources.get("XObject")), dict):
        raise PdfError("no image resources")
    for _, ref, _ in images(doc, resources):
        if isinstance(ref, Ref):
            doc.objects[ref.number] = stream
            return True
    return False


def add_layer(doc: Document, page: dict[str, Any], resources: dict | None, operators: bytes) -> None:
    """Appends operators to a page, and the font they name, without touching what other pages share."""
    resources = dict(resources or {})
    fonts = dict(doc.get(resources.get("Font")) or {})
    if "Helvetica" not in fonts:
        fonts["Helvetica"] = doc.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
    page["Resources"] = resources | {"Font": fonts}
    before = doc.get(page.get("Contents"))
    before = before if isinstance(before, list) else [] if before is None else [page["Contents"]]
    page["Contents"] = [*before, doc.add(Stream({}, operators))]


def add_archive_metadata(doc: Document) -> None:
    """New Info, and XMP that claims PDF/A-2B (metadata only: no output intent, no embedded fonts)."""
    info = doc.trailer.get("Info")
    if not isinstance(info, Ref):
        info = doc.trailer["Info"] = doc.add(None)
    doc.objects[info.number] = {"Producer": PRODUCER.encode(), "Creator": PRODUCER.encode()}
    ref = doc.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, XMP.encode()))
    (doc.trailer if doc.catalog is None else doc.catalog)["Metadata"] = ref


def written(x: Any) -> bytes:
    """One object in the file's syntax."""
    if x is None or isinstance(x, bool):
        return {None: b"null", True: b"true", False: b"false"}[x]
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, Name):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], x.encode("latin-1"))
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, float):
        return f"{x:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, list):
        return b"[" + b" ".join(map(written, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(written(Name(k)) + b" " + written(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return written(x.entries | {"Length": len(x.data)}) + b"\nstream\n" + x.data + b"\nendstream"
    raise PdfError(f"can't write {type(x).__name__}")


def _compressed(x: Any) -> Any:
    if isinstance(x, Stream) and "Filter" not in x.entries and x.entries.get("Type") != "Metadata" and len(small := zlib.compress(x.data, 9)) < len(x.data):
        return Stream(x.entries | {"Filter": Name("FlateDecode")}, small)
    return x


def save(doc: Document) -> bytes:
    """The file: plain streams compressed where that makes them smaller, one cross-reference table."""
    out, places = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], {}
    at = len(out[0])
    for number in sorted(n for n, x in doc.objects.items() if not (isinstance(x, Stream) and x.entries.get("Type") in ("XRef", "ObjStm"))):
        body = b"%d 0 obj\n%s\nendobj\n" % (number, written(_compressed(doc.objects[number])))
        places[number], at = at, at + len(body)
        out.append(body)
    size = max(places, default=0) + 1
    rows = [b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size)]
    kept = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID", "Metadata")}
    return b"".join([*out, b"xref\n0 %d\n" % size, *rows, b"trailer\n", written(kept | {"Size": size}), b"\nstartxref\n%d\n%%%%EOF\n" % at])


def new_document(sheets: list[tuple[float, float, Stream | None, bytes]]) -> Document:
    """A document of (width, height, image, content operators) sheets."""
    doc = Document()
    root = doc.add(None)
    tree, kids = doc.add(None), []
    for width, height, image, content in sheets:
        resources = {"XObject": {"Im0": doc.add(image)}} if image is not None else {}
        page = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, width, height], "Resources": resources, "Contents": doc.add(Stream({}, content))}
        kids.append(doc.add(page))
    doc.objects[tree.number] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    doc.objects[root.number] = {"Type": Name("Catalog"), "Pages": tree}
    doc.trailer["Root"] = root
    return doc
