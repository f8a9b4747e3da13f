"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

Detected values are validated (Luhn, mod 97, octet ranges, calendar, numbering plan) and
then permuted inside the set of valid values of their format, by a balanced Feistel
network over integers with cycle walking. Equal values get equal pseudonyms in every
document; the separators, the length and the kind of the value stay, and the key holder
can undo it. Dates keep their notation and link across notations, month-first ones too (whether a day is past
the twelfth is kept); a time of day behind one stays. Addresses of version 6 are permuted as numbers, so they
link across notations, and undoing one may write it in another. Every character of a
mail address's local part and domain labels is permuted within its class; the top-level
domain stays. Addresses that differ by case only have pseudonyms that differ by case only.
The key is the secret: whoever has it can undo all pseudonyms, so there is no default but in
the registered queries, where the setting ``KEY_SETTING`` replaces a key that is public.

Defined cases: null text stays null; text without findings is unchanged; other columns pass
through untouched; rows with equal or null ids are treated alike; a value is replaced by the
first kind that claims it, in the order of ``KINDS``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import slices

KINDS = ("email", "iban", "ip", "card", "ssn", "date", "phone")
ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: A key that everybody knows, for tests and samples, and the Spark setting that holds the real one.
PUBLIC_KEY, KEY_SETTING = b"foliospark pseudonyms", "spark.foliospark.pii.key"

# English month names, and lengths of IBANs by country.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_MONTH = "|".join(MONTHS + tuple(m[:3] for m in MONTHS))
_PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)|(?<![\w:.])[23][0-9A-Fa-f]{3}:[0-9A-Fa-f:]{2,34}(?![\w:]|\.\d)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}(?P<amex>[ -])\d{6}(?P=amex)\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": rf"(?<![\w./-])(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}|\d{{1,2}} (?:{_MONTH})\.?,? \d{{4}}|(?:{_MONTH})\.? \d{{1,2}},? \d{{4}})(?:(?![\w/-])|(?=T\d\d:?\d\d))",
    "phone": r"(?<![\w+(.-])(?:(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(?\d{2,8}\)?){1,6}|(?:1[ .-])?(?:\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}(?P<dash>[-. ])\d{3}(?P=dash)\d{4}))(?![\w-])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in KINDS[1:]))
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]+")
#: No pattern starts further before a digit, or ends further behind one.
_BEFORE, _BEHIND = 16, 64


class Feistel:
    """A keyed permutation of the integers below ``size`` (and its inverse)."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.size, self.half, self.mask = size, half, (1 << half) - 1
        self.keys = [hashlib.blake2b(f"{tweak}:{size}:{r}".encode(), key=hashlib.sha256(key).digest()).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "big"), key=self.keys[r], digest_size=(self.half + 7) // 8).digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._f(r, a), a
            else:
                a, b = b, a ^ self._f(r, b)
        return a << self.half | b

    def walk(self, x: int, valid: Callable[[int], bool] = lambda _: True, *, back: bool = False) -> int:
        """Permutes ``x`` among the valid integers below ``size``; ``x`` must be one."""
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


@lru_cache(maxsize=256)
def feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def luhn_digit(payload: str) -> str:
    """The check digit that makes ``payload`` + digit pass Luhn's test."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _refill(shape: str, symbols: str) -> str:
    """Puts ``symbols`` where ``shape`` has ASCII letters or digits."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 2  # the first digit names the scheme and stays, the last is the check digit
    body = f"{feistel(key, f'card{d[0]}', 10**n).walk(int(d[1:-1]), back=back):0{n}d}"
    return _refill(value, d[0] + body + luhn_digit(d[0] + body))


def _iban_value(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(value: str, key: bytes, back: bool) -> str | None:
    v = value.replace(" ", "")
    if IBAN_LENGTHS.get(v[:2]) != len(v) or _iban_value(v[4:] + v[:4]) % 97 != 1:
        return None
    body = _classes(v[4:], key, "iban" + v[:2], back)
    return _refill(value, f"{v[:2]}{98 - _iban_value(body + v[:2] + '00') % 97:02d}{body}")


def _is_host(x: int) -> bool:
    return 1 <= x >> 24 <= 223 and x >> 24 not in (10, 127)


def _ip(value: str, key: bytes, back: bool) -> str | None:
    if ":" in value:
        return _ip6(value, key, back)
    try:
        x = int(ipaddress.IPv4Address(value))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(feistel(key, "ip", 1 << 32).walk(x, _is_host, back=back))) if _is_host(x) else None


def _ip6(value: str, key: bytes, back: bool) -> str | None:
    """Global unicast addresses, permuted as numbers: written out in full if they came so, else shortened; in the case they came in."""
    try:
        x = int(ipaddress.IPv6Address(value))
    except ValueError:
        return None
    if x >> 125 != 1:
        return None
    new = ipaddress.IPv6Address(1 << 125 | feistel(key, "ip6", 1 << 125).walk(x & ((1 << 125) - 1), back=back))
    text = new.exploded if len(value) == 39 else new.compressed
    return text.upper() if any(c.isupper() for c in value) else text


def _is_ssn(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    x = int(_digits(value))
    return _refill(value, f"{feistel(key, 'ssn', 10**9).walk(x, _is_ssn, back=back):09d}") if _is_ssn(x) else None


def _date(value: str, key: bytes, back: bool) -> str | None:
    """Day-first unless that is no date; written back in the notation it came in.

    Days up to the twelfth and later ones are permuted among themselves, whatever the notation: then a
    later day stays one, and a date that was read month first is read so again.
    """
    parts = re.split(r"([^0-9A-Za-z]+)", value)
    fields = parts[::2]
    words = [i for i, x in enumerate(fields) if x.isalpha()]
    orders = [(0, 1, 2)] if len(fields[0]) == 4 else [(2, words[0], 1 - words[0])] if words else [(2, 1, 0), (2, 0, 1)]
    low, high = date(FIRST_YEAR, 1, 1).toordinal(), date(LAST_YEAR, 12, 31).toordinal()
    for y, m, d in orders:
        try:
            month = [x[:3] for x in MONTHS].index(fields[m][:3]) + 1 if words else int(fields[m])
            day = date(int(fields[y]), month, int(fields[d])).toordinal()
        except ValueError:
            continue
        if not low <= day <= high:
            return None
        late = date.fromordinal(day).day > 12
        new = date.fromordinal(low + feistel(key, "date", high - low + 1).walk(day - low, lambda x: (date.fromordinal(low + x).day > 12) == late, back=back))
        wide = lambda old, x: f"{x:02d}" if len(old) == 2 and (old[0] == "0" or all(len(f) >= 2 for f in fields)) else str(x)
        name = MONTHS[new.month - 1]
        fields[y], fields[d] = f"{new.year:04d}", wide(fields[d], new.day)
        fields[m] = (name[:3] if len(fields[m]) == 3 and fields[m] != "May" else name) if words else wide(fields[m], new.month)
        parts[::2] = fields
        return "".join(parts)
    return None


def _phone(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if not 9 <= len(d) <= 15:
        return None
    if len(d) == 10 or len(d) == 11 and d[0] == "1":
        # area and exchange codes start with 2 to 9; other numbers stay others
        plan = lambda x: 2 * 10**9 <= x and x // 10**6 % 10 >= 2
        ok = plan(int(d[-10:]))
        return _refill(value, d[:-10] + f"{feistel(key, f'phone10{ok}', 10**10).walk(int(d[-10:]), lambda x: plan(x) == ok, back=back):010d}")
    keep = 4 if d.startswith("00") else 2  # the country code, or most of it
    n = len(d) - keep
    return _refill(value, d[:keep] + f"{feistel(key, f'phone{n}', 10**n).walk(int(d[keep:]), back=back):0{n}d}")


def _classes(text: str, key: bytes, tweak: str, back: bool, *, fold: bool = False) -> str:
    """Permutes all letters and digits together, each within its class, others stay; folded, a letter's case stays but counts for nothing."""
    symbols = [c for c in text if c.isalnum()]
    read = [c.lower() for c in symbols] if fold else symbols
    first = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in read]
    radix = [10 if f == "0" else 26 for f in first]
    size, x = 1, 0
    for c, r, f in zip(read, radix, first, strict=True):
        size, x = size * r, x * r + ord(c) - ord(f)
    if size == 1:
        return text
    x, out = feistel(key, tweak + "".join(first), size).walk(x, back=back), []
    for r, f, c in zip(reversed(radix), reversed(first), reversed(symbols), strict=True):
        x, digit = divmod(x, r)
        new = chr(ord(f) + digit)
        out.append(new.upper() if fold and c.isupper() else new)
    return _refill(text, "".join(reversed(out)))


def _email(value: str, key: bytes, back: bool) -> str:
    """Compared without regard to case, which each letter keeps; the top-level domain stays."""
    local, _, domain = value.rpartition("@")
    labels, _, top = domain.rpartition(".")
    return f"{_classes(local, key, 'mail', back, fold=True)}@{_classes(labels, key, 'host', back, fold=True)}.{top}"


_PERMUTE = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes = PUBLIC_KEY, back: bool = False) -> str | None:
    """The pseudonym of a value of ``kind``; None if it isn't a valid one. ``back`` undoes it."""
    return _PERMUTE[kind](value, key, back)


def replaced(text: str, key: bytes = PUBLIC_KEY, *, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced in the old text."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        at = 0
        while (hit := text.find("@", at)) >= 0:
            first = hit
            while first and (text[first - 1] in "._%+-" or text[first - 1].isascii() and text[first - 1].isalnum()):
                first -= 1
            m = _EMAIL.match(text, first)
            if m and m.end() > hit:
                found.append((m.start(), m.end(), "email", pseudonym("email", m[0], key, back)))
            at = max(hit + 1, m.end() if m else 0)
    mails = list(found)
    for first, last in _regions(text):
        at = first
        while m := _FIND.search(text, at, last):
            kind = next(k for k in KINDS[1:] if m[k] is not None)
            new = None
            if not any(a < m.end() and m.start() < b for a, b, *_ in mails):
                new = pseudonym(kind, m[0], key, back)
                if new is None:  # not valid as this kind: the later kinds may claim the same place
                    for other in KINDS[KINDS.index(kind) + 1 :]:
                        n = _SINGLE[other].match(text, m.start())
                        if n and (new := pseudonym(other, n[0], key, back)) is not None:
                            m, kind = n, other
                            break
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
                at = m.end()
            else:
                at = _next_start(text, m)
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in found]


_SINGLE = {k: re.compile(_PATTERNS[k]) for k in KINDS[1:]}


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around its digits; outside them nothing can match."""
    first = last = -1
    for m in _DIGITS.finditer(text):
        if m.start() - _BEFORE > last:
            if last >= 0:
                yield first, last
            first = max(0, m.start() - _BEFORE)
        last = m.end() + _BEHIND
    if last >= 0:
        yield first, last


def _next_start(text: str, m: re.Match) -> int:
    """After the first run of letters and digits of a match that no kind claimed."""
    at = m.start() + 1
    while at < m.end() and text[at].isalnum():
        at += 1
    return at


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(key: bytes, names: list[str], spans: str | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [(None, []) if t is None else replaced(t, key) for t in batch.column("text").to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if n == "text" else batch.column(n) for n in names]
            if spans:
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *([spans] if spans else [])])

    return scan


def configured_key(spark: SparkSession) -> bytes:
    """The key in the setting ``KEY_SETTING``; where it is unset, the public one, which protects nothing."""
    value = spark.conf.get(KEY_SETTING, None)
    return value.encode() if value else PUBLIC_KEY


def pseudonymise(documents: DataFrame, key: bytes, *, spans: str | None = None) -> DataFrame:
    """All columns of ``documents`` with pseudonyms in ``text``; ``spans`` names a further column for what was replaced (a column of that name must not exist)."""
    typed = documents.withColumn("text", F.col("text").cast("string"))
    added = [T.StructField(spans, T._parse_datatype_string(SPANS))] if spans else []
    return typed.mapInArrow(_scan(key, typed.columns, spans), T.StructType([*typed.schema.fields, *added]))
