"""Format-preserving pseudonyms for personal data.

Numbers and dates are checked first (Luhn, mod 97, calendar, octets); what passes is mapped by a keyed Feistel
network on exactly its own format: a card number becomes a card number, a date a date. The map is a permutation that
depends only on the key, the kind and the value, so equal values stay equal in all documents, also when they are
written with different separators, and whoever holds the key can undo it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import map_batches, read, texts

FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


@dataclass(frozen=True)
class PiiParams:
    key: bytes = b"replace this key in production"
    rounds: int = 10


class Feistel:
    """A keyed permutation of 0..size-1: alternating Feistel on two uneven halves, walking cycles back into range."""

    def __init__(self, p: PiiParams, kind: str, size: int) -> None:
        self.p, self.size = p, size
        self.a = max(1, isqrt(max(size - 1, 0)) + 1)
        self.b = -(-size // self.a)
        self.tweak = f"{kind}:{size}:".encode()

    def _mix(self, k: int, x: int) -> int:
        return int.from_bytes(blake2b(self.tweak + b"%d:%d" % (k, x), key=self.p.key[:64], digest_size=32).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(self.p.rounds):
            if k % 2:
                right = (right + self._mix(k, left)) % self.b
            else:
                left = (left + self._mix(k, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(self.p.rounds - 1, -1, -1):
            if k % 2:
                right = (right - self._mix(k, left)) % self.b
            else:
                left = (left - self._mix(k, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def undo(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


@lru_cache(maxsize=4096)
def network(p: PiiParams, kind: str, size: int) -> Feistel:
    return Feistel(p, kind, size)


def permute_chars(s: str, alphabets: list[str], p: PiiParams, kind: str, undo: bool = False) -> str:
    """Maps a string to another over the same alphabets, place by place."""
    x = 0
    for c, a in zip(s, alphabets):
        x = x * len(a) + a.index(c)
    f = network(p, f"{kind}:{','.join(str(len(a)) for a in alphabets)}", prod(map(len, alphabets)))
    x = f.undo(x) if undo else f(x)
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that belongs after ``digits``."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def refill(layout: str, chars: str, what) -> str:
    """``layout`` with its characters of a kind replaced in order."""
    it = iter(chars)
    return "".join(next(it) if what(c) else c for c in layout)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


# Each takes the match and the parameters, and returns the replacement, or None if the value isn't valid.


def _card(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + permute_chars(d[1:-1], [DIGITS] * (len(d) - 2), p, f"card{d[0]}", undo)
    return refill(m[0], body + luhn_digit(body), str.isdigit)


def _phone(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    country, local = m["cc"] or "", m[0][len(m["cc"] or "") :]
    d = _digits(local)
    if not 7 <= len(d) <= 14:
        return None
    return country + refill(local, permute_chars(d, [DIGITS] * len(d), p, "phone" + _digits(country), undo), str.isdigit)


def _ip(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    f = network(p, "ip", 1 << 32)
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, (f.undo(x) if undo else f(x)).to_bytes(4, "big")))


def _ssn(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    f = network(p, "ssn", 898 * 99 * 9999)
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.undo(x) if undo else f(x), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    a, sep, b, c = m["d1"], m["ds"], m["d2"], m["d3"]
    if len(a) == 4:
        order, (y, mo, d) = "ymd", (int(a), int(b), int(c))
    elif len(c) == 4:  # day first, unless only month first is a date; a slash is month first
        order = "mdy" if (sep == "/" and int(a) <= 12) or int(b) > 12 else "dmy"
        y, mo, d = (int(c), int(a), int(b)) if order == "mdy" else (int(c), int(b), int(a))
    else:
        return None
    try:
        n = date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    f = network(p, "date", LAST_DAY - FIRST_DAY + 1)
    t = date.fromordinal(FIRST_DAY + (f.undo(n - FIRST_DAY) if undo else f(n - FIRST_DAY)))
    y, mo, d = f"{t.year:04d}", f"{t.month:02d}", f"{t.day:02d}"
    return sep.join({"ymd": (y, mo, d), "mdy": (mo, d, y), "dmy": (d, mo, y)}[order])


def _iban(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    s = m[0].replace(" ", "")
    country, check, account = s[:2], s[2:4], s[4:]
    if iban_check(country, account) != check:
        return None
    account = permute_chars(account, [DIGITS if c in DIGITS else UPPER for c in account], p, "iban" + country, undo)
    return refill(m[0], country + iban_check(country, account) + account, str.isalnum)


def _classes(s: str) -> list[str]:
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER for c in s]


def _email(m: re.Match, p: PiiParams, undo: bool) -> str | None:
    local, at, domain = m[0].rpartition("@")
    if ".." in local or local[0] == ".":
        return None
    known = "".join(c for c in local if c.isalnum())
    if not known:
        return None
    return refill(local, permute_chars(known, _classes(known), p, "email", undo), str.isalnum) + at + domain


def _key(m: re.Match, p: PiiParams, undo: bool) -> str:
    return m[0][:4] + permute_chars(m[0][4:], _classes(m[0][4:]), p, "key", undo)


def _secret(m: re.Match, p: PiiParams, undo: bool) -> str:
    s = m["value"]
    alphabets = [HEX] * len(s) if re.fullmatch("[0-9a-f]+", s) else _classes(s)
    return m[0][: m.start("value") - m.start()] + permute_chars(s, alphabets, p, "secret", undo) + m[0][m.end("value") - m.start() :]


#: Tried in this order at each place. Where a value is invalid, for GROUPED shorter ends, then the later kinds are tried; the search then goes on inside it.
KINDS = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    "key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])", _key),
    "secret": (r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*["']?(?P<value>[A-Za-z0-9]{8,})""", _secret),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "ip": (r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])", _ip),
    "date": (r"(?<![\w.,/-])(?P<d1>[0-9]{4}|[0-9]{1,2})(?P<ds>[-/.])(?P<d2>[0-9]{1,2})(?P=ds)(?P<d3>[0-9]{4}|[0-9]{1,2})(?![\w/-]|\.[0-9])", _date),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    "phone": (r"(?<![\w.+-])(?:(?P<cc>\+[0-9]{1,3})(?:[ .-]?\([0-9]{1,4}\)[ .-]?|[ .-])(?:[0-9]{2,4}[ .-]?){1,4}[0-9]{2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|\+[0-9]{8,15})(?![\w-])", _phone),
    "card": (r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-(?![0-9]))", _card),
}
EACH = {k: re.compile(r) for k, (r, _) in KINDS.items()}
GROUPED = {"iban", "card"}  #: written in groups, so that a match may hold words or numbers that follow the value
FINDER = re.compile("|".join(f"(?P<{k}>{r})" for k, (r, _) in KINDS.items()))
HINT = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)").search


def _valid(text: str, m: re.Match, p: PiiParams, undo: bool) -> tuple[str, int, str] | None:
    """(kind, end, replacement) of the first kind that is valid where ``m`` starts; of a grouped kind the longest valid one."""
    names = list(KINDS)
    for kind in names[names.index(next(k for k in KINDS if m[k] is not None)) :]:
        one = EACH[kind].match(text, m.start())
        if one is None:
            continue
        ends = [one.end()]
        if kind in GROUPED:
            ends += [k for k in range(one.end() - 1, one.start(), -1) if text[k] in " -" and text[k - 1].isalnum()]
        for end in ends:
            part = EACH[kind].fullmatch(text, m.start(), end)
            if part and (new := KINDS[kind][1](part, p, undo)) is not None:
                return kind, end, new
    return None


def pseudonymize(text: str, p: PiiParams = PiiParams(), undo: bool = False) -> tuple[str, list[str]]:
    """(text with every valid value replaced, the kinds replaced in order)."""
    if not HINT(text):
        return text, []
    found: list[str] = []
    out, at, place = [], 0, 0
    while m := FINDER.search(text, place):
        if got := _valid(text, m, p, undo):
            kind, stop, new = got
            found.append(kind)
            out += [text[at : m.start()], new]
            at = place = stop
        else:
            place = m.start() + 1
    return "".join([*out, text[at:]]), found


def pseudonymize_documents(docs: DataFrame, p: PiiParams = PiiParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_replaced, kinds for each row. A null text stays null, an empty one empty; both have no kinds."""

    def make():
        def each(b: pa.RecordBatch):
            known = b.column(1).is_valid().to_pylist()
            out = [pseudonymize(t, p) for t in texts(b.column(1))]
            new = pa.array([t if ok else None for (t, _), ok in zip(out, known)], pa.string())
            kinds = pa.array([",".join(sorted(set(f))) for _, f in out], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), new, pa.array([len(f) for _, f in out], pa.int64()), kinds], ["doc_id", "text", "n_replaced", "kinds"])

        return each

    return map_batches(docs.select(doc_id, text), "doc_id long, text string, n_replaced long, kinds string", make, text)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
