"""Format-preserving pseudonyms: personal numbers and dates are permuted within their format.

Each value found is validated (checksum, ranges, calendar) and brought to a normal form: the digits
of a card, the compact IBAN, the country code and national number of a phone (ten digits without a
country code are taken for +1), the day of a date, the lower-cased email or secret. The normal form is
mapped by a keyed Feistel permutation of all values of its kind and length and written in the notation
found: separators and length stay, a card number keeps its first digit and gets a fitting check digit,
a phone its country code, a date stays a real date of the years 1900 to 2099. So all notations of a value get one pseudonym in all
documents and stay linked, and different values never meet. A date whose notation would then be read
otherwise (day and month both up to 12) is written with the separator that keeps its order: dots for
day first, slashes for month first.

The key comes from the caller; who has it can invert the pseudonyms. `session_key` reads it from the
setting `spark.sigframe.pseudonymKey`; where that is unset, each session draws its own, and only values of
that session stay linked.

Kinds: ``card`` (13-19 digits, Luhn), ``iban`` (mod 97), ``phone`` (8-15 digits with a plus,
brackets or separators), ``ssn`` (3-2-4 digits), ``ip`` (four octets), ``date`` (year first, day
first or month first, years 1900-2099), ``email`` (letters and digits of the local part) and
``secret`` (32 or more hexadecimal digits, as in access tokens). Long numbers that fail Luhn's check
are not card numbers and stay.

Cases: null texts stay null; empty texts stay empty; a value that fails its validation stays as it
is; overlapping finds go to the first, then to the earlier kind in the order above; four octets next to a
word for a version are not an address; a permutation
may by chance map a value to itself (for dates once in 73,000). Rows of equal text get equal results; other columns are carried along;
an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.llm.common import small_batches
from sigframe.llm.feistel import permute_digits, permute_range

KEY_SETTING = "spark.sigframe.pseudonymKey"
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "secret")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
KEEP_VALUES = 100_000
#: Country codes of one and two digits (fixed values of the numbering plan); all others have three.
SHORT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
_VERSION_BEFORE = re.compile(r"(?:\b(?:version|release|build|ver|rev|v)\.?\s*)$", re.IGNORECASE)
_VERSION_AFTER = re.compile(r"\s+(?:version|release|build)\b", re.IGNORECASE)
_drawn: dict[str, bytes] = {}

#: Where a number can be; only there is the long pattern tried, in its order.
_ISLAND = re.compile(r"[+(0-9][0-9 ().+/-]{5,}")
_NUMBER = re.compile(
    r"(?<![\w.+])(?:"
    r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?P<iso>[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2})(?![\w]|[-/.][0-9])"
    r"|(?P<dmy>[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![\w]|[-/.][0-9])"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w]|[-.][0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w]|-[0-9])"
    r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w]|[-.][0-9])"
    r")"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11,38}")
_SECRET = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn_sum(digits: list[int]) -> int:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))


def luhn_ok(digits: list[int]) -> bool:
    return luhn_sum(digits) % 10 == 0


def with_check_digit(payload: list[int]) -> list[int]:
    return [*payload, -luhn_sum([*payload, 0]) % 10]


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and _iban_rest(compact) == 1


def session_key(spark: SparkSession) -> bytes:
    """The key that the session is set to, else one drawn for it."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return next((c for c in (digits[:1], digits[:2]) if c in SHORT_CODES or c in TWO_DIGIT_CODES), digits[:3])


class Pseudonyms:
    """Maps values; `back` inverts it with the same key (a date may come back with another separator)."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key, self.back = key, back
        self.kept: dict[tuple[str, str], str] = {}

    def _symbols(self, text: str, kind: str, tweak: str = "") -> str:
        """Permutes the letters and digits of a text, each within its class."""
        places = [(k, next(a for a in ("0123456789", _LOWER, _UPPER) if c in a)) for k, c in enumerate(text) if c.isascii() and c.isalnum()]
        if not places:
            return text
        form = re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text)))
        got = permute_digits([a.index(text[k]) for k, a in places], [len(a) for _, a in places], self.key, f"{kind}|{tweak}|{form}".encode(), self.back)
        out = list(text)
        for (k, a), d in zip(places, got, strict=True):
            out[k] = a[d]
        return "".join(out)

    def _digits(self, text: str, digits: list[int]) -> str:
        left = iter(digits)
        return "".join(str(next(left)) if c.isdigit() else c for c in text)

    def card(self, text: str) -> str:
        digits = [int(c) for c in text if c.isdigit()]
        middle = permute_digits(digits[1:-1], [10] * (len(digits) - 2), self.key, b"card|%d|%d" % (digits[0], len(digits)), self.back)
        return self._digits(text, with_check_digit([digits[0], *middle]))

    def phone(self, text: str) -> str:
        """Country code and a (0) after it stay; the national number is permuted."""
        trunk = re.search(r"(?<=[0-9 ])\(0\)", text) if text[0] == "+" else None
        digits = "".join(c for k, c in enumerate(text) if c.isdigit() and not (trunk and trunk.start() <= k < trunk.end()))
        code = country_code(digits) if text[0] == "+" else "1" if len(digits) == 10 else ""
        own = digits[len(code) :] if text[0] == "+" else digits
        if len(own) < 2:
            raise ValueError(text)
        made = permute_digits([int(c) for c in own], [10] * len(own), self.key, f"phone|{code}|{len(own)}".encode(), self.back)
        left = iter([*map(int, digits[: len(digits) - len(own)]), *made])
        return "".join(str(next(left)) if c.isdigit() and not (trunk and trunk.start() <= k < trunk.end()) else c for k, c in enumerate(text))

    def ssn(self, text: str) -> str:
        return self._symbols(text, "ssn")

    def ip(self, text: str) -> str:
        return ".".join(map(str, permute_digits([int(x) for x in text.split(".")], [256] * 4, self.key, b"ip", self.back)))

    def iban(self, text: str) -> str:
        compact = text.replace(" ", "")
        body = self._symbols(compact[4:], "iban", compact[:2])
        made = f"{compact[:2]}{98 - _iban_rest(compact[:2] + '00' + body):02d}{body}"
        left = iter(made)
        return "".join(c if c == " " else next(left) for c in text)

    def secret(self, text: str) -> str:
        lower = text.lower()
        got = permute_digits([int(c, 16) for c in lower], [16] * len(lower), self.key, b"secret|%d" % len(lower), self.back)
        out = "".join(f"{d:x}" for d in got)
        return out if text == lower else out.upper()

    def email(self, text: str) -> str:
        """The local part is permuted without regard to case, and cased as it was found."""
        local, at, domain = text.rpartition("@")
        made = self._symbols(local.lower(), "email", domain.lower())
        return "".join(n.upper() if c.isupper() else n for c, n in zip(local, made, strict=True)) + at + domain

    def date(self, text: str) -> str:
        """A text of three numbers; which one is the year and which the day is read from it."""
        parts = re.split(r"([-/.])", text)
        a, b, c = int(parts[0]), int(parts[2]), int(parts[4])
        if len(parts[0]) == 4:
            order = "ymd"
        else:
            order = "mdy" if a <= 12 and (b > 12 or parts[1] == "/") else "dmy"
        y, m, d = (dict(zip(order, (a, b, c), strict=True))[x] for x in "ymd")
        day = dt.date(y, m, d).toordinal()
        if not FIRST_DAY <= day <= LAST_DAY:
            raise ValueError(text)
        narrow = any(len(p) == 1 for p in parts[::2])
        day = FIRST_DAY + permute_range(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, self.key, b"date", self.back)
        new, mark = dt.date.fromordinal(day), parts[1]
        if order != "ymd" and new.day <= 12 and (mark == "/") == (order == "dmy"):  # it would be read the other way
            mark = "." if order == "dmy" else "/"
        fields = {"y": f"{new.year:04d}", "m": f"{new.month}" if narrow else f"{new.month:02d}", "d": f"{new.day}" if narrow else f"{new.day:02d}"}
        return mark.join(fields[x] for x in order)

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value doesn't pass its kind's check."""
        found = self.kept.get((kind, text))
        if found is None:
            if len(self.kept) >= KEEP_VALUES:
                self.kept.clear()
            found = self.kept[kind, text] = self._checked(kind, text) or ""
        return found or None

    def _checked(self, kind: str, text: str) -> str | None:
        if kind == "card":
            digits = [int(c) for c in text if c.isdigit()]
            return self.card(text) if 13 <= len(digits) <= 19 and luhn_ok(digits) else None
        if kind == "iban" and not iban_ok(text):
            return None
        if kind == "ip" and not all(int(x) < 256 for x in text.split(".")):
            return None
        if kind == "phone" and not 8 <= sum(c.isdigit() for c in text) <= 15:
            return None
        if kind == "secret" and (text.isdigit() or text.isalpha()):
            return None
        try:
            return getattr(self, kind)(text)
        except ValueError:
            return None


def find_values(text: str) -> list[tuple[int, int, str]]:
    """Places of candidate values (start, end, kind), in order, none overlapping."""
    found = []
    for island in _ISLAND.finditer(text):
        for m in _NUMBER.finditer(text, island.start(), min(len(text), island.end() + 1)):
            kind = next(k for k in ("ip", "iso", "dmy", "phone", "ssn", "card") if m[k])
            if kind == "ip" and (_VERSION_BEFORE.search(text, max(0, m.start() - 12), m.start()) or _VERSION_AFTER.match(text, m.end())):
                continue
            found.append((m.start(), m.end(), "date" if kind in ("iso", "dmy") else kind))
    for m in _SECRET.finditer(text):
        if not text[max(0, m.start() - 1) : m.start()].isalnum() and not text[m.end() : m.end() + 1].isalnum():
            found.append((m.start(), m.end(), "secret"))
    m = _IBAN.search(text)
    while m:
        end = 0
        if not text[max(0, m.start() - 1) : m.start()].isalnum():
            end = next((k for k in range(m.end(), m.start() + 14, -1) if not text[k - 1 : k].isspace() and not text[k : k + 1].isalnum() and iban_ok(text[m.start() : k])), 0)
            if end:
                found.append((m.start(), end, "iban"))
        m = _IBAN.search(text, end or m.start() + 1)
    at = text.find("@")
    while at >= 0:  # only around an @, so that long texts are read once
        head = _LOCAL.search(text, max(0, at - 128), at)
        m = _EMAIL.match(text, head.start()) if head else None
        while head and not m and (start := head.start() + 1) < at:
            head = _LOCAL.search(text, start, at)
            m = _EMAIL.match(text, start) if head else None
        if m and m.end() > at:
            found.append((m.start(), m.end(), "email"))
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def pseudonymise(text: str, names: Pseudonyms) -> tuple[str, list[str]]:
    """The text with its values replaced, and the kinds of those values in order."""
    out, kinds, at = [], [], 0
    for start, end, kind in find_values(text):
        if new := names.of(kind, text[start:end]):
            out += [text[at:start], new]
            kinds.append(kind)
            at = end
    return ("".join([*out, text[at:]]), kinds) if kinds else (text, kinds)


def pseudonymise_texts(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`df` with its text column replaced under the key, and pii_kinds array<string>: what was replaced, in order."""
    Pseudonyms(key)  # refuses an empty key here already
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != "pii_kinds"]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            made = [(None, []) if x is None else pseudonymise(x, names) for x in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([m[0] for m in made], pa.string())
            yield pa.record_batch([*columns, pa.array([m[1] for m in made], pa.list_(pa.string()))], names=[*keep, "pii_kinds"])

    out = df.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in keep])
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("pii_kinds", T.ArrayType(T.StringType()))]))
