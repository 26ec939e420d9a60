"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Values are found by pattern, validated (Luhn for cards, mod 97 for IBANs, octets, calendar dates ...), turned into a number in the exact
domain of their format, permuted there and written back in the same format, so a card stays a valid card and a date a valid date.
The network adds a keyed round function of one part to the other, modulo the other's size; that is a bijection for any two sizes. Domains
without two real parts (dates, single letters or digits) are permuted in the next larger product of two nearly equal sizes, again and
again until the result is inside. The permutation depends only on key, kind and domain: equal values get equal pseudonyms in all documents,
whatever separators they are written with, and the key holder can undo them.

Kinds, in the order in which an overlap is settled: secret (known forms of keys and tokens, and values assigned to a password or key that hold a digit or sign, mix cases or
stand in quotes; each character within its class), email (letters and digits before the @), iban, card, ip, ssn, phone, date.
Of a phone the calling code (after a +, or where more than ten digits are left) and zeros before the national number stay; the national number is permuted among those as long that
start with no zero either. So a subscriber has one pseudonym with or without the code or a trunk zero and however it is spaced. E-mail letters of any script are permuted among the letters of
their kind in their part of the code table. IBANs are found in upper case, and in lower case when written without spaces.
Dates stay within DATES; year-month-day (with - or /), day/month and month/day forms keep their form. Days up to the 12th and later days are permuted apart, so
a month/day form stays one, and a date has the same pseudonym in every form; whether the day is past the 12th stays visible. Numbers that do not validate stay as they are.
Not looked for: IPv6 addresses, dates before 1900, and phones without a + that are not split into groups.

The key is the caller's; there is no default. Registered queries take it from the session (KEY_SETTING), or else a test key, with a warning.

Defined results: null text stays null, empty stays empty, no value found leaves the text as it is; a value next to letters or digits
is not one; of overlapping values the first kind counts, and within a kind the leftmost; texts of any length are searched whole; repeated rows get equal results; an empty table gives
none; a column named pii_found is replaced, all others stay.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import unicodedata
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm.storage import small_batches
from veriledger.llm.workers import lean

KEY_SETTING, TEST_KEY = "spark.veriledger.pseudonymKey", "tests only"
ROUNDS = 10
DATES = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())
_HEADS = r"AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk-"
#: Calling codes of countries, fixed values: those of one and two digits are listed, all others have three.
CALLING_CODE = r"(?:[17]|2(?:[07]|\d\d)|3(?:[0-469]|\d\d)|4(?:[013-9]|2\d)|5(?:[1-8]|\d\d)|6(?:[0-6]|\d\d)|8(?:[1246]|\d\d)|9(?:[0-58]|\d\d))"
PATTERNS = {
    "secret": r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
    r"|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}(?:\"[^\s\"]{6,}\"|'[^\s']{6,}'|[^\s\"'<>,;]{6,}))",
    "email": r"(?<![\w.+%-])[^\W_][\w.+%-]{0,63}@[^\W_](?:[^\W_]|-){0,62}(?:\.[^\W_](?:[^\W_]|-){0,62})*\.[^\W\d_]{2,24}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)|(?<!\w)[a-z]{2}\d{2}[a-z0-9]{11,30}(?!\w)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": rf"(?<![\w.+-])(?:\+\d{{1,3}}[ .-]?|{CALLING_CODE}[ .-])?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}(?![\w]|[.-]\d)|(?<![\w.+-])\+\d{{8,14}}(?!\w)"
    r"|(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]\d{2}){3,5}|0\d(?:[ .-]\d{2}){4})(?!\w|[.-]\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
}
#: What a text has to hold for a kind to be there at all.
NEEDS = {"secret": re.compile(rf"[=:]|{_HEADS}"), "email": re.compile("@")} | {k: re.compile(r"\d") for k in PATTERNS if k not in ("secret", "email")}
KINDS = tuple(PATTERNS)
#: Digits are ASCII; letters next to a value are of any script.
_FOUND = {k: re.compile(p if k == "email" else p.replace(r"\d", "[0-9]")) for k, p in PATTERNS.items()}


class Feistel:
    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _f(self, tag: str, i: int, value: int, size: int) -> int:
        said = hashlib.blake2b(f"{tag}/{i}/{value}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(said, "big") % size

    def permute(self, tag: str, value: int, a: int, b: int) -> int:
        """A bijection of [0, a * b)."""
        tag = f"{tag}/{a}/{b}"
        left, right = divmod(value, b)
        for i in range(self.rounds):
            if i % 2 == 0:
                left = (left + self._f(tag, i, right, a)) % a
            else:
                right = (right + self._f(tag, i, left, b)) % b
        return left * b + right

    def undo(self, tag: str, value: int, a: int, b: int) -> int:
        tag = f"{tag}/{a}/{b}"
        left, right = divmod(value, b)
        for i in reversed(range(self.rounds)):
            if i % 2 == 0:
                left = (left - self._f(tag, i, right, a)) % a
            else:
                right = (right - self._f(tag, i, left, b)) % b
        return left * b + right

    def walk(self, tag: str, value: int, size: int, back: bool = False) -> int:
        """A bijection of [0, size) with two real parts: permuted in a * b >= size until the result is inside."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        tag = f"{tag}/{size}"
        while True:
            value = (self.undo if back else self.permute)(tag, value, a, b)
            if value < size:
                return value

    def digits(self, tag: str, values: list[int], radices: list[int], back: bool = False) -> list[int]:
        """Permutes the mixed-radix numbers of these radices."""
        if len(radices) == 1:
            return [self.walk(tag, values[0], radices[0], back)]
        half = len(radices) // 2
        a = b = 1
        for r in radices[:half]:
            a *= r
        for r in radices[half:]:
            b *= r
        number = 0
        for v, r in zip(values, radices, strict=True):
            number = number * r + v
        number = (self.undo if back else self.permute)(tag, number, a, b)
        out = []
        for r in reversed(radices):
            number, v = divmod(number, r)
            out.append(v)
        return out[::-1]


def luhn(digits: list[int]) -> int:
    """The check digit for these."""
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, new: str) -> str:
    """The characters of new in place of the letters and digits of shape."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in shape)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@functools.lru_cache(4096)
def _class_of(x: str) -> str | None:
    """The characters that x may become: ASCII ones of its kind, else the letters or digits of its category among the 128 code points around it. None for other characters."""
    if x.isascii() or not x.isalnum():
        return next((c for c in _CLASSES if x in c), None)
    first = ord(x) & ~127
    return "".join(c for c in map(chr, range(first, first + 128)) if c.isalnum() and unicodedata.category(c) == unicodedata.category(x) and not c.isascii())


def _letters(f: Feistel, tag: str, text: str, back: bool) -> str:
    """Letters and digits permuted, each within its class; others stay."""
    classes = [_class_of(x) for x in text]
    own = [(c.index(x), len(c)) for x, c in zip(text, classes, strict=True) if c]
    if not own:
        return text
    new = iter(f.digits(tag, [v for v, _ in own], [r for _, r in own], back))
    return "".join(c[next(new)] if c else x for x, c in zip(text, classes, strict=True))


def _date(shape: str) -> tuple[datetime.date, str] | None:
    parts = re.split(r"[-/.]", shape)
    try:
        if len(parts[0]) == 4:
            return datetime.date(*map(int, parts)), "ymd"
        a, b, year = map(int, parts)
        if "." in shape or b <= 12:
            return datetime.date(year, b, a), "dmy"
        return datetime.date(year, a, b), "mdy"
    except ValueError:
        return None


def _before_national(digits: str, international: bool) -> int:
    """How many digits of a phone come before its national number: zeros, a calling code, zeros."""
    at = len(digits) - len(digits.lstrip("0"))
    if international or len(digits) - at > 10:
        code = re.compile(CALLING_CODE).match(digits, at)
        at = code.end() if code else at
        at = len(digits) - len(digits[at:].lstrip("0"))
    return at


def pseudonym(f: Feistel, kind: str, text: str, back: bool = False) -> str | None:
    """The text's pseudonym (or, back, the original), None if it does not validate."""
    if kind == "secret":
        head = re.match(rf"(?:{_HEADS})|.*?[=:][\s\"']*", text, re.DOTALL)[0]
        value = text[len(head) :]
        if head[-1] in "=:\t\n " and not re.search(r"[^\W_]", value[:-1] if value[-1:] in ".!?)" else value):
            return None
        if head[-1] in "=:\t\n " and re.fullmatch(r"[A-Z]?[a-z]+[.!?:)]*|[A-Z]+[.!?:)]*|[^\x00-\x7F\d]*[A-Za-z]*[^\x00-\x7F\d]+[A-Za-z]*[.!?:)]*", value):  # a word of prose
            return None
        return head + _letters(f, "secret", value, back)
    if kind == "email":
        local, _, domain = text.partition("@")
        return _letters(f, "email/" + domain.lower(), local, back) + "@" + domain
    digits = [int(c) for c in text if c.isdigit() and c.isascii()]
    if kind == "card":
        if len(set(digits)) == 1 or luhn(digits[:-1]) != digits[-1]:
            return None
        new = f.digits("card", digits[:-1], [10] * (len(digits) - 1), back)
        return _refill(text, "".join(map(str, [*new, luhn(new)])))
    if kind == "iban":
        plain = text.replace(" ", "").upper()
        if _mod97(plain[4:] + plain[:4]) != 1:
            return None
        new = _letters(f, "iban/" + plain[:2], plain[4:], back)
        check = 98 - _mod97(new + plain[:2] + "00")
        done = f"{plain[:2]}{check:02d}{new}"
        return _refill(text, done.lower() if text[0].islower() else done)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        return ".".join(map(str, f.digits("ip", octets, [256] * 4, back)))
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        place, group, serial = f.digits("ssn", [place, group - 1, serial - 1], [898, 99, 9999], back)
        return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        keep = _before_national("".join(map(str, digits)), "+" in text)
        own = digits[keep:]
        if not own:
            return None
        first, *rest = f.digits("phone", [own[0] - 1, *own[1:]], [9] + [10] * (len(own) - 1), back)
        return _refill(text, "".join(map(str, [*digits[:keep], first + 1, *rest])))
    found = _date(text)
    if not found or not DATES[0] <= found[0].toordinal() < DATES[1]:
        return None
    day, order = found
    late = day.day > 12
    days, places = (_LATE, _LATE_PLACE) if late else (_EARLY, _EARLY_PLACE)
    ordinal = days[f.walk("date/late" if late else "date/early", places[day.toordinal() - DATES[0]], len(days), back)]
    new_day = datetime.date.fromordinal(ordinal + DATES[0])
    if order == "ymd":
        mark = text[4]
        wide = re.fullmatch(r"\d{4}.\d\d.\d\d", text)
        return new_day.isoformat().replace("-", mark) if wide else f"{new_day.year}{mark}{new_day.month}{mark}{new_day.day}"
    mark = "." if "." in text else "/"
    first, second = (new_day.day, new_day.month) if order == "dmy" else (new_day.month, new_day.day)
    wide = re.match(r"0\d|\d\d[/.]\d\d", text)
    return f"{first:02d}{mark}{second:02d}{mark}{new_day.year}" if wide else f"{first}{mark}{second}{mark}{new_day.year}"


_LATE, _EARLY = ([o - DATES[0] for o in range(*DATES) if (datetime.date.fromordinal(o).day > 12) == late] for late in (True, False))
_LATE_PLACE, _EARLY_PLACE = ({o: i for i, o in enumerate(days)} for days in (_LATE, _EARLY))


def replace(f: Feistel, text: str, memo: dict | None = None) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and what was found: kind, begin and end in the original, pseudonym."""
    found: list[tuple] = []
    taken = None
    for kind, pattern in _FOUND.items():
        if not NEEDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            if taken is not None and 1 in taken[m.start() : m.end()]:
                continue
            new = None if memo is None else memo.get((kind, m[0]))
            if new is None:
                new = pseudonym(f, kind, m[0])
                if memo is not None and new is not None and len(memo) < 100_000:
                    memo[kind, m[0]] = new
            if new is not None:
                taken = bytearray(len(text)) if taken is None else taken
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found.append((m.start(), m.end(), kind, new))
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [{"kind": k, "begin": a, "end": b, "pseudonym": new} for a, b, k, new in found]


ENTITIES = "array<struct<kind:string,begin:long,end:long,pseudonym:string>>"


def session_key(spark: SparkSession) -> bytes:
    """The session's key; where none is set, the test key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a key that everybody knows", stacklevel=2)
    return (key or TEST_KEY).encode()


def pseudonymise(docs: DataFrame, *, key: bytes) -> DataFrame:
    """The columns of docs, text with pseudonyms, and pii_found: kind, begin, end (characters of the original text) and pseudonym."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != "pii_found"]
    source = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", pii_found " + ENTITIES
    at = columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches):
        f, memo = Feistel(key), {}
        for batch in batches:
            new = [(None, []) if t is None else replace(f, t, memo) for t in batch.column(at).to_pylist()]
            own = list(batch.columns)
            own[at] = pa.array([t for t, _ in new], pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array([x for _, x in new], kind)], [*batch.schema.names, "pii_found"])

    return source.mapInArrow(lean(run), schema)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=session_key(spark))
    of = lambda kind: F.size(F.filter("pii_found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", F.size("pii_found").cast("long").alias("n_found"), *map(of, KINDS), "text")


QUERIES = {"op2_feistel_pseudonyms": op2_feistel_pseudonyms}
