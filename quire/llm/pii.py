"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A found value is validated (check digits, octets, calendar), mapped to its index among all values of
its format, permuted there and written back in the same layout. The map depends on the key, the kind
and the value alone, so equal values stay linked across documents however they are punctuated. The
permutation is E^-1(E(x) + 1): a bijection without fixed points, so no value is left as it was.

The key is the caller's: an argument or the session's ``quire.pii.key``. Where neither is given one is drawn
for the call, so pseudonyms then link values within its result only, and nobody can undo them.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import append_columns, rows_of

ROUNDS = 8
KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "date")
#: The setting that holds the key.
KEY_SETTING = "quire.pii.key"
#: Letters of a mail name at most; longer ones are no address.
LONGEST_NAME = 64


class Feistel:
    """Permutations of range(n) for any n >= 2, keyed and told apart by a label."""

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key, digest_size=32).digest()

    def _f(self, label: bytes, i: int, x: int) -> int:
        return int.from_bytes(blake2b(b"%s|%d|%d" % (label, i, x), key=self.key, digest_size=32).digest(), "big")

    def _walk(self, x: int, n: int, label: bytes, rounds: range, sign: int) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # cycle walking: the Feistel square is less than one row or column larger than n
            left, right = divmod(x, b)
            for i in rounds:
                if i % 2:
                    right = (right + sign * self._f(label, i, left)) % b
                else:
                    left = (left + sign * self._f(label, i, right)) % a
            x = left * b + right
            if x < n:
                return x

    def encrypt(self, x: int, n: int, label: bytes) -> int:
        return self._walk(x, n, label, range(ROUNDS), 1)

    def decrypt(self, x: int, n: int, label: bytes) -> int:
        return self._walk(x, n, label, range(ROUNDS - 1, -1, -1), -1)

    def replace(self, x: int, n: int, label: bytes) -> int:
        return self.decrypt((self.encrypt(x, n, label) + 1) % n, n, label)

    def restore(self, x: int, n: int, label: bytes) -> int:
        return self.decrypt((self.encrypt(x, n, label) - 1) % n, n, label)


Move = Callable[[int, int, bytes], int]


#: What a doubled digit adds to a check sum.
DOUBLED = {c: 2 * int(c) - 9 * (c > "4") for c in "0123456789"}
GAPS = str.maketrans("", "", " -")


def luhn_digit(payload: str) -> int:
    return -(sum(map(DOUBLED.__getitem__, payload[::-2])) + sum(map(int, payload[-2::-2]))) % 10


def _relay(layout: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``layout``."""
    take = iter(digits)
    return "".join(next(take) if c.isdigit() else c for c in layout)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str, move: Move) -> str | None:
    d = s.translate(GAPS)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or not int(d):
        return None
    n = len(d) - 1
    new = f"{move(int(d[:-1]), 10**n, b'card%d' % n):0{n}d}"
    return _relay(s, new + str(luhn_digit(new)))


def _ip(s: str, move: Move) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255:
        return None
    x = move(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(s: str, move: Move) -> str | None:
    area, pair, serial = (int(p) for p in s.split("-"))
    if area in (0, 666) or area > 899 or not pair or not serial:
        return None
    x = move(((area - 1 - (area > 666)) * 99 + pair - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
    x, serial = divmod(x, 9999)
    area, pair = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{pair + 1:02d}-{serial + 1:04d}"


def _phone(s: str, move: Move) -> str | None:
    lead = re.match(r"\+[0-9]{1,3}(?![0-9])", s)
    head = lead[0] if lead else ""
    d = _digits(s[len(head) :])
    if not 7 <= len(d) <= 14 or not 8 <= len(d) + len(head) <= 18:
        return None
    return head + _relay(s[len(head) :], f"{move(int(d), 10 ** len(d), b'phone%d' % len(d)):0{len(d)}d}")


#: Character classes that are permuted within themselves. Fixed values.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _mixed(s: str, move: Move, label: bytes) -> str | None:
    """Letters stay letters of their case, digits digits, the rest stays."""
    sets = [next((k for k in CLASSES if c in k), "") for c in s]
    sizes = [len(k) for k in sets if k]
    if not sizes:
        return None
    x = 0
    for c, k in zip(s, sets, strict=True):
        x = x * len(k) + k.index(c) if k else x
    shape = "".join("-" if not k else k[0] for k in sets)
    x, out = move(x, prod(sizes), label + shape.encode()), []
    for c, k in zip(reversed(s), reversed(sets), strict=True):
        if k:
            x, r = divmod(x, len(k))
            c = k[r]
        out.append(c)
    return "".join(reversed(out))


def _email(s: str, move: Move) -> str | None:
    local, _, host = s.rpartition("@")
    if len(local) > LONGEST_NAME:
        return None
    new = _mixed(local, move, b"email@" + host.lower().encode())
    return new and f"{new}@{host}"


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _iban(s: str, move: Move) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    new = _mixed(flat[4:], move, b"iban" + flat[:2].encode())
    if not new:
        return None
    take = iter(flat[:2] + _iban_check(flat[:2], new) + new)
    return "".join(c if c == " " else next(take) for c in s)


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _shape(field: str, other: str) -> str:
    """How a day or month is written: one digit, padded (0), two digits for want of one (T), or any padded value (2)."""
    if len(field) == 1:
        return "1"
    if len(other) == 2:
        return "2"
    return "0" if field[0] == "0" else "T"


@lru_cache(maxsize=128)
def _days(second: bool, day: str, month: str) -> list[int]:
    """The dates that a layout of these shapes can hold and that are read back in the same order."""
    allowed = {"1": range(1, 10), "0": range(1, 10), "T": range(10, 32), "2": range(1, 32)}
    every = map(dt.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return [d.toordinal() for d in every if d.day in allowed[day] and d.month in allowed[month] and (not second or d.day > 12)]


def _date(s: str, move: Move) -> str | None:
    """A valid date becomes another one of the same layout: digits stay as many, and it is read in the same order."""
    a, sep, b, _, c = re.split(r"([-/.])", s)
    orders = ((0, 1, 2),) if len(a) == 4 else ((2, 0, 1), (2, 1, 0)) if sep == "/" else ((2, 1, 0), (2, 0, 1))
    for nth, order in enumerate(orders):  # month first with slashes, else day first, whichever is a day of the calendar
        year, month, day = ((a, b, c)[i] for i in order)
        try:
            at = dt.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= at <= LAST_DAY:
            break
    else:
        return None
    shapes = _shape(day, month), _shape(month, day)
    days = _days(nth > 0, *shapes)
    new = dt.date.fromordinal(days[move(bisect_left(days, at), len(days), b"date" if nth == 0 and shapes == ("2", "2") else b"date%d%s%s" % (nth, *(x.encode() for x in shapes)))])
    fields = dict(zip(order, (str(new.year), *(f"{v:02d}" if x in "02" else str(v) for v, x in ((new.month, shapes[1]), (new.day, shapes[0])))), strict=True))
    return sep.join(fields[i] for i in range(3))


RULES: dict[str, Callable[[str, Move], str | None]] = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone, "date": _date}

#: One alternation, in the order of KINDS; a value is tried as the first kind whose shape it has.
SHAPES = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:?[0-9]{2})|[./-][0-9]))"
)
MAYBE = re.compile(r"[0-9@]")
FIRST_GROUP = re.compile(r"[A-Z]{2}[0-9]{2}|[0-9]+")


#: Lengths of IBANs by country.
IBAN_LENGTHS = {c: int(n) for n, cs in (pair.split(":") for pair in (
    "15:NO 16:BE 18:DK,FK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}


def shorter(run: str, kind: str) -> list[int]:
    """Ends of shorter values at the start of a run, longest first: where groups end; for an IBAN of a known country, where its length ends one."""
    ends = [i for i in range(len(run) - 1, 12, -1) if run[i] in " -" and run[i - 1] not in " -"]
    if kind == "card":
        return ends
    length = IBAN_LENGTHS.get(run[:2])
    return [i for i in ends if length is None or len(run[:i].replace(" ", "")) == length]


class Pseudonymiser:
    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, replacement) of validated values, in order, code points.

        Where the longest run of a card or IBAN fails validation, shorter ones from the same start are tried, longest
        first; else the value is passed over and the search goes on behind its first group.
        """
        out, at = [], 0
        if not MAYBE.search(text):
            return out
        while m := SHAPES.search(text, at):
            kind, end = m.lastgroup, m.end()
            new = RULES[kind](m[0], self.feistel.replace)
            if new is None and kind in ("card", "iban"):
                for end in shorter(m[0], kind):
                    if (new := RULES[kind](m[0][:end], self.feistel.replace)) is not None:
                        end += m.start()
                        break
            if new is None and kind in ("card", "iban"):  # the same characters may hold a shorter value of another kind
                inner = FIRST_GROUP.match(m[0])
                at = m.start() + max(1, inner.end() if inner else 1)
                continue
            if new is not None:
                out.append((m.start(), end, kind, new))
            at = end
        return out

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        spans, parts, at, counts = self.spans(text), [], 0, dict.fromkeys(KINDS, 0)
        for start, end, kind, new in spans:
            parts += (text[at:start], new)
            at = end
            counts[kind] += 1
        return "".join([*parts, text[at:]]), counts


@lru_cache(maxsize=4)
def pseudonymiser(key: bytes) -> Pseudonymiser:
    return Pseudonymiser(key)


def key_of(spark: SparkSession, key: bytes | None = None) -> bytes:
    """The given key, else the session's, else a new one."""
    named = spark.conf.get(KEY_SETTING, None)
    return key or (named.encode() if named else os.urandom(32))


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every validated value in ``text`` replaced; all columns stay, null stays null.

    Works on whole texts in place, without a shuffle, in time linear in a text whatever it holds. Empty
    texts and tables come back as they are, repeated rows get the same text, null ids are rows like others.
    """
    key = key_of(docs.sparkSession, key)

    def make(texts: list[str]) -> list[list]:
        apply = pseudonymiser(key).apply
        return [[apply(t)[0] for t in texts]]

    return append_columns(docs, text, make, [(text, pa.string(), "string")], replace=True)


def pseudonym_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text (replaced), n_<kind> for each kind and n_values, of (doc_id, text).

    Null texts stay null with counts of 0; null ids and repeated rows are reported like others; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    key = key_of(docs.sparkSession, key)

    def make(texts: list[str]) -> list[list]:
        done = [pseudonymiser(key).apply(t) for t in texts]
        return [[d[0] for d in done], *([d[1][k] for d in done] for k in KINDS), [sum(d[1].values()) for d in done]]

    fields = [("text", pa.string(), "string"), *((f"n_{k}", pa.int64(), "long") for k in (*KINDS, "values"))]
    return append_columns(rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string")), "text", make, fields, replace=True)
