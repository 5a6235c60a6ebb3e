"""Operator 3: format-preserving pseudonyms from a keyed Feistel permutation.

Values are found by pattern and validated (Luhn for cards, mod 97 for IBANs,
octets, area numbers, the calendar for dates).  A valid value becomes an
integer of its format's domain, is permuted by a keyed Feistel network and
written back with the separators it had, so equal values get equal pseudonyms
in every document, whatever their separators.  The permutation is conjugate to
a rotation of its domain, so no value is mapped to itself; ``unmask`` inverts it.

Kinds: card, iban, ssn, phone (without separators only behind a word such as
``tel``; national ones begin with 0), ip (version 6 keeps its notation), date (1900
to 2099; day first where only that is valid, else month first with ``/``; years of
two digits are 1950 to 2049 and linked among themselves; names of months in
English, German, French and Spanish stay in their language; a time behind a date
stays), email (the local part), and secret (access keys, bearer tokens, and a value
with a digit assigned to a name such as ``password``).  Digits stay digits and letters letters, in hexadecimal secrets
letters up to ``f``.

The key is needed: who knows it can invert a corpus.  ``session_key`` takes it from
the setting ``spark.pulsemill.pii.key``, and without one draws a secret key for
this application.

A card or IBAN that isn't valid as it is matched may have swallowed a neighbour
(an expiry date, a house number, a word in capitals): the longest valid value
between its separators is taken, and if there is none the scan goes on one token
behind its start.

Edge cases: a null text stays null and an empty one empty; invalid numbers stay
as they are; repeated rows give equal rows; an empty table an empty result;
other columns are passed on, but one named as ``spans`` is replaced; a very long
text is scanned in linear time.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .textkit import table

ROUNDS = 8
#: Fixed lists of month names.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Fixed list of the countries that have IBANs; in small letters no others are taken for one.
COUNTRIES = set(
    "ad ae al at az ba be bg bh br by ch cr cy cz de dk do ee eg es fi fo fr gb ge gi gl gr gt hr hu ie il iq is it jo kw kz lb lc li lt lu lv ly mc md me mk mr mt mu nl no pk pl ps pt qa ro rs sa sc sd se si sk sm st sv tl tn "
    "tr ua va vg xk".split()
)
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()

SHORT_FIRST, SHORT_DAYS = date(1950, 1, 1).toordinal(), date(2050, 1, 1).toordinal() - date(1950, 1, 1).toordinal()

MONTH = "|".join(rf"{m}|{m[:3]}\.?" for m in MONTHS["en"])
ANY_MONTH = "|".join([MONTH, *(m for names in MONTHS.values() for m in names)])
PATTERN = re.compile(
    rf"""
    (?<![\w.+-])(?P<email>[\w.+-]++)@[\w-]+(?:\.[\w-]+)+
  | (?<![A-Za-z0-9])(?P<key>(?:AKIA|ASIA)[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9-]{{20,}})(?![A-Za-z0-9])
  | (?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?[ \t]*[:=][ \t]*["']?)(?P<secret>[A-Za-z0-9+/_-]{{8,}})
  | (?i:\bbearer[ ]+)(?P<bearer>[A-Za-z0-9._~+/-]{{16,}})
  | (?<![A-Za-z0-9])(?P<iban>[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?|[a-z]{{2}}[0-9]{{2}}(?:[ ]?[a-z0-9]{{4}}){{2,7}}(?:[ ]?[a-z0-9]{{1,3}})?)(?![A-Za-z0-9])
  | (?<![\w.])(?P<ip>[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?!\w|\.[0-9])
  | (?<![\w:.])(?P<ip6>(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}})(?![\w:])
  | (?<![\w./-])(?P<ymd>[0-9]{{4}}(?P<m1>[-/.])[0-9]{{1,2}}(?P=m1)[0-9]{{1,2}})(?!(?!T[0-9]{{2}}:?[0-9]{{2}})\w|[-/.][0-9])
  | (?<![\w./-])(?P<dmy>[0-9]{{1,2}}(?P<m2>[-/.])[0-9]{{1,2}}(?P=m2)[0-9]{{4}})(?!\w|[-/.][0-9])
  | (?<![\w./-])(?P<short>[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}|[0-9]{{2}}(?P<m3>[.-])[0-9]{{2}}(?P=m3)[0-9]{{2}})(?!\w|[-/.][0-9])
  | (?<!\w)(?P<d_month>[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)?[ ](?:de[ ])?(?i:{ANY_MONTH})[ ](?:de[ ])?[0-9]{{4}})(?!\w)
  | (?<!\w)(?P<month_d>(?:{MONTH})[ ][0-9]{{1,2}}(?:st|nd|rd|th)?,?[ ][0-9]{{4}})(?!\w)
  | (?<![\w-])(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![\w-])
  | (?<![\w-])(?<![0-9][ ])(?P<spaced>[0-9]{{3}}[ ][0-9]{{2}}[ ][0-9]{{4}})(?![\w-]|[ ][0-9])
  | (?<![\w+])(?P<phone>(?:\+1[ .-]?)?(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}|\+[0-9](?:[ .()-]{{0,2}}[0-9]){{7,14}})(?![0-9])
  | (?i:\b(?:tel|phone|call|mobile|cell|fax)\w*[.:]?[ ]?[:]?[ ]*)(?P<bare>[2-9][0-9]{{2}}[2-9][0-9]{{6}})(?![0-9]|[ -][0-9])
  | (?<![\w+])(?<![0-9][ ])(?P<national>(?=(?:[0-9][ ]?){{10,11}}(?![ ]?[0-9]))0[0-9]{{2,4}}[ ][0-9]{{3,4}}[ ][0-9]{{3,4}})(?![0-9]|[ -][0-9])
  | (?<![0-9.])(?P<dotted>[0-9]{{4}}\.[0-9]{{4}}\.[0-9]{{4}}\.[0-9]{{1,4}})(?![0-9]|\.[0-9])
  | (?<![0-9])(?P<card>[0-9](?:[ -]?[0-9]){{12,18}})(?![0-9])
    """,
    re.VERBOSE,
)
MAY_MATCH = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z0-9]+|(?s:.)")
GROUP = re.compile(r"[A-Za-z0-9]+")
SUBSCRIBER = re.compile(r"[2-9][0-9]{2}[2-9]")
HEXA = re.compile(r"(?=.*[a-f])[0-9a-f]{16,}")
#: What is written in ``spans`` for the names of the pattern's groups that stand for forms of one kind.
KINDS = {"ymd": "date", "dmy": "date", "d_month": "date", "month_d": "date", "short": "date", "key": "secret", "bearer": "secret", "ip6": "ip", "bare": "phone", "national": "phone", "spaced": "ssn", "dotted": "card"}
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}|[a-z]{2}[0-9]{2}[a-z0-9]{8,31}")
DAY_MONTH = re.compile(r"(?P<d>[0-9]{1,2})(?P<nth>st|nd|rd|th|er|\.)?(?P<gap>[ ](?:de[ ])?)(?P<name>[^\W\d_]+)(?P<rest>.*?)(?P<y>[0-9]{4})")
MONTH_DAY = re.compile(r"(?P<name>[A-Za-z]+)(?P<gap>\.?[ ])(?P<d>[0-9]{1,2})(?P<nth>st|nd|rd|th)?(?P<rest>,?[ ])(?P<y>[0-9]{4})")


class Feistel:
    """A keyed permutation of the integers below n, without fixed points for n > 1."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.left = n, isqrt(max(n - 1, 0)) + 1
        self.right = -(-n // self.left)
        self.hash = hashlib.blake2b(f"{tweak}:{n}".encode(), key=hashlib.sha256(key).digest())

    def _f(self, j: int, x: int) -> int:
        h = self.hash.copy()
        h.update(b"%d:%d" % (j, x))
        return int.from_bytes(h.digest(), "big")

    def _encrypt(self, x: int) -> int:
        while True:
            r, le = divmod(x, self.left)
            for j in range(ROUNDS):
                if j % 2:
                    r = (r + self._f(j, le)) % self.right
                else:
                    le = (le + self._f(j, r)) % self.left
            x = r * self.left + le
            if x < self.n:
                return x

    def _decrypt(self, x: int) -> int:
        while True:
            r, le = divmod(x, self.left)
            for j in reversed(range(ROUNDS)):
                if j % 2:
                    r = (r - self._f(j, le)) % self.right
                else:
                    le = (le - self._f(j, r)) % self.left
            x = r * self.left + le
            if x < self.n:
                return x

    def apply(self, x: int, step: int = 1) -> int:
        return self._decrypt((self._encrypt(x) + step) % self.n)


def luhn_digit(digits: str) -> int:
    """The check digit that makes the number valid."""
    return -sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def month_of(name: str, dotted: bool) -> tuple[str, int, bool]:
    """Language, number and shortness of a month's name.

    Names of several languages are German behind a dot, else English; ``Mai`` is
    German in capitals, ``mai`` French.
    """
    low = name.lower()
    found = {lang: names.index(m) + 1 for lang, names in MONTHS.items() for m in names if m.lower() == low}
    if len(low) == 3 and low != "mai":
        return "en", next(i for i, m in enumerate(MONTHS["en"], 1) if m[:3].lower() == low), True
    german = dotted or name == "Mai"
    lang = "de" if german and "de" in found else next(x for x in ("en", "fr", "de", "es") if x in found)
    return lang, found[lang], False


def ordinal(day: int) -> str:
    return "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


class Masker:
    """Pseudonyms under one key; ``step`` -1 inverts them."""

    def __init__(self, key: bytes, step: int = 1):
        self.key, self.step = key, step
        self.network = lru_cache(4096)(lambda tweak, n: Feistel(key, tweak, n))
        self.value = lru_cache(1 << 16)(self._value)

    def number(self, tweak: str, digits: str) -> str:
        if not digits:
            return digits
        return str(self.network(tweak, 10 ** len(digits)).apply(int(digits), self.step)).zfill(len(digits))

    def subscriber(self, digits: str) -> str:
        """Ten digits of a phone number: numbers that may be written without separators stay such, and the others too."""
        begin = bool(SUBSCRIBER.match(digits))
        while True:
            digits = self.number("phone", digits)
            if bool(SUBSCRIBER.match(digits)) == begin:
                return digits

    def characters(self, tweak: str, text: str, hexa: bool = False) -> str:
        """Each letter or digit changes inside its own class; pieces of 32 characters are permuted one by one."""
        low = text.lower() if len(text.lower()) == len(text) else text
        letters = LOWER[:6] if hexa else LOWER
        out = []
        for at in range(0, len(low), 32):
            kinds = [next((k for k in (DIGITS, letters, ACCENTED) if c in k), c) for c in low[at : at + 32]]
            n = x = 0
            size = 1
            for c, k in zip(low[at : at + 32], kinds, strict=True):
                x, size = x * len(k) + k.index(c), size * len(k)
            n = self.network(f"{tweak}{at}", size).apply(x, self.step)
            piece = []
            for k in reversed(kinds):
                n, i = divmod(n, len(k))
                piece.append(k[i])
            out += reversed(piece)
        return "".join(c.upper() if o.isupper() and len(c.upper()) == 1 else c for c, o in zip(out, text, strict=True))

    def day(self, y: int, m: int, d: int) -> date | None:
        try:
            n = date(y, m, d).toordinal() - FIRST_DAY
        except ValueError:
            return None
        return date.fromordinal(self.network("date", DAYS).apply(n, self.step) + FIRST_DAY) if 0 <= n < DAYS else None

    def short_day(self, y: int, m: int, d: int) -> date | None:
        """The same for years of two digits."""
        try:
            n = date(y + (1900 if y >= 50 else 2000), m, d).toordinal() - SHORT_FIRST
        except ValueError:
            return None
        return date.fromordinal(self.network("short", SHORT_DAYS).apply(n, self.step) + SHORT_FIRST)

    def named_day(self, m: re.Match, month_first: bool) -> str | None:
        lang, month, short = month_of(m["name"], m["nth"] == ".")
        new = self.day(int(m["y"]), month, int(m["d"]))
        if new is None:
            return None
        name = MONTHS[lang][new.month - 1]
        name = name[:3] if short else name
        name = name.upper() if m["name"].isupper() else name.lower() if m["name"].islower() else name.capitalize()
        nth = m["nth"] or ""
        day = f"{new.day}{nth if nth in ('', '.', 'er') else ordinal(new.day)}"
        return f"{name}{m['gap']}{day}{m['rest']}{new.year}" if month_first else f"{day}{m['gap']}{name}{m['rest']}{new.year}"

    @staticmethod
    def refill(shape: str, digits: str) -> str:
        """The digits in the places of the digits (or capitals) of ``shape``."""
        it = iter(digits)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None where it isn't valid."""
        digits = re.sub(r"[^0-9]", "", text)
        if kind == "email":
            return self.characters("email", text)
        if kind == "key":
            keep = 3 if text.startswith("sk-") else 4
            return text[:keep] + self.characters("secret", text[keep:])
        if kind in ("secret", "bearer"):
            return self.characters("secret", text, hexa=bool(HEXA.fullmatch(text))) if digits else None
        if kind == "ip6":
            try:
                ipaddress.IPv6Address(text)
            except ValueError:
                return None
            several = digits and len([x for x in text.split(":") if x]) > 2
            return self.characters("ip6", text, hexa=True) if several else None
        if kind == "bare":
            return self.subscriber(digits)
        if kind in ("card", "dotted"):
            if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            body = self.number("card", digits[:-1])
            return self.refill(text, body + str(luhn_digit(body)))
        if kind == "iban":
            plain = text.replace(" ", "")
            country, check, rest = plain[:2], plain[2:4], plain[4:]
            if iban_check(country, rest) != int(check) or country.islower() and country not in COUNTRIES:
                return None
            rest = self.characters("iban" + country.upper(), rest)
            return self.refill(text, f"{country}{iban_check(country, rest):02d}{rest}")
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255:
                return None
            n = self.network("ip", 1 << 32).apply(int.from_bytes(bytes(octets), "big"), self.step)
            return ".".join(str(x) for x in n.to_bytes(4, "big"))
        if kind in ("ssn", "spaced"):
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            areas = [*range(1, 666), *range(667, 900)]
            n = self.network("ssn", len(areas) * 99 * 9999).apply((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, self.step)
            return self.refill(text, f"{areas[n // (99 * 9999)]:03d}{n // 9999 % 99 + 1:02d}{n % 9999 + 1:04d}")
        if kind == "national":
            return self.refill(text, "0" + self.number("phone0", digits[1:]))
        if kind == "phone":
            if text[0] != "+" or digits[0] == "1" and len(digits) == 11:
                return self.refill(text, digits[:-10] + self.subscriber(digits[-10:]))
            return self.refill(text, digits[0] + self.number("phone" + digits[0], digits[1:]))
        if kind == "d_month":
            return self.named_day(DAY_MONTH.fullmatch(text), False)
        if kind == "month_d":
            return self.named_day(MONTH_DAY.fullmatch(text), True)
        mark = re.search("[-/.]", text)[0]
        parts = text.split(mark)
        wide = all(len(x) > 1 for x in parts)
        of = self.short_day if kind == "short" else self.day
        if kind == "ymd":
            new = self.day(*map(int, parts))
            order = "ymd"
        else:
            a, b, y = map(int, parts)
            month_first = mark == "/" and a <= 12
            new = of(y, a, b) if month_first else None
            order = "mdy" if new else "dmy"
            new = new or of(y, b, a)
        if new is None:
            return None
        parts = {"y": f"{new.year % 100:02d}" if kind == "short" else str(new.year), "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
        return mark.join(parts[x] for x in order)

    def inside(self, kind: str, text: str) -> tuple[int, int] | None:
        """Start and end of the longest valid value between separators of an invalid card or IBAN.

        A card's groups but the last have four digits or more, as cards are
        printed, or else rows of small numbers would hold many.
        """
        groups = [g.span() for g in GROUP.finditer(text)]
        found = []
        for i, (a, _) in enumerate(groups):
            for j in range(i, len(groups)):
                b = groups[j][1]
                part = "".join(text[x:y] for x, y in groups[i : j + 1])
                if kind == "card" and j > i and groups[j - 1][1] - groups[j - 1][0] < 4:
                    break
                if 13 <= len(part) <= 19 if kind == "card" else IBAN.fullmatch(part):
                    found.append((-len(part), a, b))
        return next(((a, b) for _, a, b in sorted(found) if self.value(kind, text[a:b]) is not None), None)

    def mask(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the new text."""
        if not MAY_MATCH.search(text):
            return text, []
        out, spans, at, size = [], [], 0, 0
        scan = 0
        while m := PATTERN.search(text, scan):
            kind = m.lastgroup
            start, end = m.span(kind)
            new = self.value(kind, m[kind])
            if new is None and kind in ("card", "iban") and (part := self.inside(kind, m[kind])):
                start, end = start + part[0], start + part[1]
                new = self.value(kind, text[start:end])
            if new is None:
                scan = TOKEN.match(text, m.start()).end()  # a value may begin inside
                continue
            before = text[at:start]
            out += (before, new)
            size += len(before) + len(new)
            at = end
            scan = m.end() if end == m.end(kind) else end
            spans.append((KINDS.get(kind, kind), size - len(new), size))
        return "".join([*out, text[at:]]), spans


_drawn = secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.pulsemill.pii.key``; where it is unset, a random one that ends with this application."""
    given = spark.conf.get("spark.pulsemill.pii.key", None)
    return given.encode() if given else _drawn


def pseudonymise(docs: DataFrame, text: str = "text", *, key: bytes, step: int = 1, spans: str | None = "pii_spans") -> DataFrame:
    """The table with ``text`` masked and, unless ``spans`` is None, a list of (kind, start, end) in code points."""
    if not key:
        raise ValueError("a key is needed")
    columns = [c for c in docs.columns if c != spans]
    schema = docs.select(*columns).schema
    if spans:
        schema = schema.add(spans, T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        masker = Masker(key, step)
        for batch in batches:
            done = [None if x is None else masker.mask(x) for x in batch.column(text).to_pylist()]
            new = pa.array([None if x is None else x[0] for x in done], pa.string())
            arrays = [new if c == text else batch.column(c) for c in columns]
            if spans:
                found = [[] if x is None else [{"kind": k, "start": a, "end": b} for k, a, b in x[1]] for x in done]
                arrays.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(*columns).mapInArrow(run, schema)


def unmask(docs: DataFrame, text: str = "text", *, key: bytes) -> DataFrame:
    """Undoes ``pseudonymise`` for values whose pseudonym is read back as the same kind and span.

    Exceptions are ambiguous ``/`` dates, dates whose day or month has one digit on one side alone, months
    by the name May (full and short), German dates without a dot behind the day, and cards or IBANs beside digits or capitals that happen to make a valid longer one with the pseudonym.
    """
    return pseudonymise(docs, text, key=key, step=-1, spans=None)


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark))
