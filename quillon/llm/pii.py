"""Format-preserving pseudonyms for personal numbers and dates.

A found value that its own rule confirms (check digit, octets, calendar) is taken
as a number within the set of all values of the same format, and sent through a
keyed Feistel network with cycle walking, a permutation of that set. So equal
values get equal pseudonyms in every document, different values different ones,
the layout stays, the pseudonym passes the same rule, and the key undoes it.

Kinds: payment card (Luhn), IBAN (mod 97), US social security number, phone,
IPv4 address, calendar date, e-mail (local part).

Cases: a null text stays null with no findings; an empty text stays empty;
repeated rows are handled each for itself; an empty table gives an empty result.
All is row by row: no shuffle.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches
from .textbytes import task_batches

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
ROUNDS = 10
#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_RUN = re.compile(r"[+(]?\d[\d ().+/\-]{5,}\d")
_IN_RUN = re.compile(
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?![.\d]))"
    r"|(?P<date>\d{4}([-/.])\d{1,2}\3\d{1,2}(?![\d])|\d{1,2}([-/.])\d{1,2}\4\d{4}(?!\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![-\d]))"
    r"|(?P<card>\d(?:[ -]?\d){12,18}(?![\d]))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ -]?\d){7,12}(?!\d))"
)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]+)@((?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of each country's IBAN.
_IBAN_LENGTH = {
    cc: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for cc in countries.split()
}
#: An IBAN with its spaces is shorter than this.
_IBAN_REACH = 80


class Cipher:
    """A keyed permutation of the numbers below any bound; each tweak has its own."""

    def __init__(self, key: bytes, forward: bool = True):
        self.key, self.forward = hashlib.sha256(key).digest(), forward

    def _round(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        raw = x.to_bytes(size, "big")
        out = hashlib.blake2b(raw, key=self.key, digest_size=max(size, 8), person=hashlib.blake2b(tweak + bytes([r, bits & 255]), digest_size=16).digest()).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, x: int, bound: int, tweak: bytes) -> int:
        if bound < 2:
            return x
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            if self.forward:
                for r in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, r, right, half)
            else:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, r, left, half), left
            x = left << half | right
            if x < bound:
                return x

    def walk(self, x: int, bound: int, tweak: bytes, ok: Callable[[int], bool]) -> int:
        """Permutes those numbers below bound that ok accepts, x being one."""
        x = self.permute(x, bound, tweak)
        while not ok(x):
            x = self.permute(x, bound, tweak)
        return x

    def characters(self, s: str, tweak: bytes) -> str:
        """s with its ASCII digits and letters permuted, each position keeping its class."""
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        base = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in s]
        value = bound = 0
        bound = 1
        for c, r, b in zip(s, radix, base, strict=True):
            if r > 1:
                value, bound = value * r + ord(c) - ord(b), bound * r
        value = self.permute(value, bound, tweak + "".join(base[i] if radix[i] > 1 else "." for i in range(len(s))).encode())
        out = []
        for c, r, b in zip(reversed(s), reversed(radix), reversed(base), strict=True):
            if r == 1:
                out.append(c)
            else:
                value, d = divmod(value, r)
                out.append(chr(ord(b) + d))
        return "".join(reversed(out))


def luhn_digit(payload: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _lay(found: str, digits: str) -> str:
    """found with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in found)


def _card(c: Cipher, s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 2
    body = str(c.walk(int(d[1:-1]), 10**n, b"card%d%c" % (n, ord(d[0])), lambda x: len(set(d[0] + str(x).zfill(n))) > 1)).zfill(n)
    return _lay(s, d[0] + body + str(luhn_digit(d[0] + body)))


def _ssn_ok(x: int) -> bool:
    area = x // 1_000_000
    return area not in (0, 666) and area < 900 and x // 10_000 % 100 > 0 and x % 10_000 > 0


def _ssn(c: Cipher, s: str) -> str | None:
    x = int(s.replace("-", ""))
    return _lay(s, str(c.walk(x, 10**9, b"ssn", _ssn_ok)).zfill(9)) if _ssn_ok(x) else None


def _phone(c: Cipher, s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 7 <= len(d) <= 15:
        return None
    # a country code stays; the subscriber's digits keep whether they begin with 0 or 1
    m = re.match(r"\+(\d{1,3})[ .(\-]", s)
    head = m[1] if m else (d[:1] if s.startswith("+") else "")
    tail = d[len(head) :]
    n = len(tail)
    kind = lambda x: str(x).zfill(n)[0] in "01"
    own = kind(int(tail))
    return _lay(s, head + str(c.walk(int(tail), 10**n, b"phone%d" % n, lambda x: kind(x) == own)).zfill(n))


def _ip(c: Cipher, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = c.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(c: Cipher, s: str) -> str | None:
    parts = re.split(r"[-/.]", s)
    year_first = len(parts[0]) == 4
    year, a, b = (int(parts[0]), int(parts[1]), int(parts[2])) if year_first else (int(parts[2]), int(parts[1]), int(parts[0]))
    order = "ymd" if year_first else "dmy"
    try:
        day = dt.date(year, a, b).toordinal()
    except ValueError:
        if year_first:
            return None
        order = "mdy"
        try:
            day = dt.date(year, b, a).toordinal()
        except ValueError:
            return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    wide = [len(p) for p in parts]
    places = order.replace("y", "")
    small = tuple(wide[1:] if year_first else wide[:2])

    def spell(x: int) -> str | None:
        """The date in the same layout, if it is read back as the same day and has the same widths."""
        t = dt.date.fromordinal(FIRST_DAY + x)
        two = [str({"m": t.month, "d": t.day}[p]) for p in places]
        if tuple(len(v.zfill(2)) if w == 2 else len(v) for v, w in zip(two, small, strict=True)) != small:
            return None
        if order == "mdy" and t.day <= 12:
            return None  # it would be read as day and month
        two = [v.zfill(2) if w == 2 else v for v, w in zip(two, small, strict=True)]
        sep = re.search(r"[-/.]", s)[0]
        return sep.join([str(t.year).zfill(4), *two] if year_first else [*two, str(t.year).zfill(4)])

    x = c.walk(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, f"date{order}{small}".encode(), lambda x: spell(x) is not None)
    return spell(x)


def _email(c: Cipher, s: str) -> str | None:
    local, _, host = s.rpartition("@")
    return c.characters(local, b"email") + "@" + host


def _iban_ok(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


def _next_iban(text: str, at: int) -> tuple[int, int] | None:
    """The first confirmed IBAN from `at` on. The pattern takes in upper-case words and numbers that follow:
    the country's own length counts first, then the whole match, and shorter ends for countries not listed."""
    while m := _IBAN.search(text, at):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        size = _IBAN_LENGTH.get(m[0][:2])
        if size:
            ends = [e for e in ends if len(text[m.start() : e].replace(" ", "")) == size] + ends[:1]
        for e in ends:
            if _iban_ok(text[m.start() : e].replace(" ", "")):
                return m.start(), e
        at = m.start() + 1
    return None


def _iban(c: Cipher, s: str) -> str | None:
    plain = s.replace(" ", "")
    if not _iban_ok(plain):
        return None
    body = c.characters(plain[4:], b"iban" + plain[:2].encode())
    new = plain[:2] + str(98 - _mod97(body + plain[:2] + "00")).zfill(2) + body
    it = iter(new)
    return "".join(" " if x == " " else next(it) for x in s)


_RULES = {"card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email, "iban": _iban}


class Pseudonymiser:
    """Replaces confirmed values of a text; values already met are remembered (a bounded table)."""

    def __init__(self, key: bytes, forward: bool = True):
        cipher = Cipher(key, forward)
        self.value = lru_cache(1 << 16)(lambda kind, s: _RULES[kind](cipher, s))

    def _sub(self, pattern: re.Pattern, kind: str, text: str, counts: dict[str, int]) -> str:
        def put(m: re.Match) -> str:
            new = self.value(kind, m[0])
            if new is None:
                return m[0]
            counts[kind] += 1
            return new

        return pattern.sub(put, text)

    def _run(self, run: str, left_open: bool, counts: dict[str, int]) -> str:
        out, at = [], 0
        while at < len(run):
            fresh = at == 0 and left_open or at > 0 and not run[at - 1].isalnum() and run[at - 1] != "."
            m = _IN_RUN.match(run, at) if fresh and (run[at].isdigit() or run[at] in "+(") else None
            new = None
            if m:
                kind = m.lastgroup if m.lastgroup in _RULES else next(k for k in ("ip", "date", "ssn", "card", "phone") if m[k])
                found = m[0]
                new = self.value(kind, found)
                if new is None and kind == "card":  # two numbers side by side, or a longer phone
                    for cut in [i for i, x in enumerate(found) if x in " -"][::-1]:
                        if len(re.sub(r"\D", "", found[:cut])) >= 13 and (new := self.value(kind, found[:cut])) is not None:
                            found = found[:cut]
                            break
            if new is not None:
                counts[kind] += 1
                out.append(new)
                at += len(found)
            else:
                out.append(run[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        if "@" in text:
            text = self._sub(_EMAIL, "email", text, counts)
        if counts["email"]:  # numbers are looked for between addresses only
            parts, at = [], 0
            for m in _EMAIL.finditer(text):
                parts += [self._numbers(text[at : m.start()], counts), m[0]]
                at = m.end()
            return "".join([*parts, self._numbers(text[at:], counts)]), counts
        return self._numbers(text, counts), counts

    def _put_iban(self, text: str, at: int, span: tuple[int, int]) -> str:
        """The pseudonym of an IBAN, permuted on until the same place is found in the new text."""
        start, end = span
        low = max(at, start - _IBAN_REACH)
        left, right = text[max(low - 1, 0) : start], text[end : end + _IBAN_REACH]
        first, new = low - max(low - 1, 0), self.value("iban", text[start:end])
        while _next_iban(left + new + right, first) != (len(left), len(left) + len(new)):
            new = self.value("iban", new)
        return new

    def _numbers(self, text: str, counts: dict[str, int]) -> str:
        parts, at = [], 0
        while span := _next_iban(text, at):  # other numbers are looked for between IBANs only
            parts += [self._plain_numbers(text[at : span[0]], counts), self._put_iban(text, at, span)]
            counts["iban"] += 1
            at = span[1]
        return "".join([*parts, self._plain_numbers(text[at:], counts)])

    def _plain_numbers(self, text: str, counts: dict[str, int]) -> str:
        def put(m: re.Match) -> str:
            return self._run(m[0], m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "._"), counts)

        return _RUN.sub(put, text)


SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", text string"


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", forward: bool = True) -> DataFrame:
    """(doc_id, counts by kind, text) of every row; forward=False undoes it with the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymiser(key, forward)
        digit = re.compile(r"\d")
        for batch in task_batches(batches):
            texts, rows, size, first = [], [], 0, 0
            for r in range(batch.num_rows):
                t = batch.column(1)[r].as_py()
                counts = dict.fromkeys(KINDS, 0)
                if t and ("@" in t or digit.search(t)):
                    t, counts = change(t)
                texts.append(t)
                rows.append([counts[k] for k in KINDS])
                size += len(t or "")
                if size > 4 << 20 or r + 1 == batch.num_rows:
                    numbers = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *numbers, pa.array(texts, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "text"])
                    texts, rows, size, first = [], [], 0, r + 1

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
