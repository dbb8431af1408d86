"""Format-preserving pseudonyms for personal data and secrets.

Found values are validated (check digits, ranges, calendar), and what identifies
them is permuted inside the set of values of the same format by a keyed Feistel
network: digits stay digits, separators stay where they are, check digits are
computed anew, dates stay dates. The permutation depends on the key and the format
alone, so that equal values get equal pseudonyms in all documents and different
values never meet. No table of values is kept anywhere.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """A keyed permutation of range(n), by an alternating network over two digits a*b >= n and cycle walking."""

    def __init__(self, key: str) -> None:
        if not key:
            raise ValueError("a key is needed")
        raw = key.encode()
        # the hash takes keys of 64 bytes: longer ones count whole by their own hash
        self.key = raw if len(raw) <= 64 else hashlib.blake2b(raw, person=b"long key").digest()

    def _round(self, label: bytes, i: int, x: int, most: int) -> int:
        data = b"%b|%d|%d" % (label, i, x)
        size = max(16, (most.bit_length() + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "big") % most

    def permute(self, x: int, n: int, label: str) -> int:
        """The image of x among 0..n-1, for this key and label."""
        return self._walk(x, n, label, False)

    def restore(self, x: int, n: int, label: str) -> int:
        """The inverse of :meth:`permute`."""
        return self._walk(x, n, label, True)

    def _walk(self, x: int, n: int, label: str, back: bool) -> int:
        if n < 2:
            return x
        a = max(2, _root(n))
        b = -(-n // a)
        tag = f"{label}|{n}".encode()
        while True:
            high, low = divmod(x, b)
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    low = (low + sign * self._round(tag, i, high, b)) % b
                else:
                    high = (high + sign * self._round(tag, i, low, a)) % a
            x = high * b + low
            if x < n:
                return x

    def text(self, value: str, label: str) -> str:
        """Every digit and ASCII letter by one of its own kind, everything else as it is."""
        kinds = [next((k for k in (DIGITS, LOWER, UPPER) if c in k), None) for c in value]
        n = x = 0
        size = 1
        for c, k in zip(value, kinds, strict=True):
            if k:
                x, size, n = x * len(k) + k.index(c), size * len(k), n + 1
        x = self.permute(x, size, f"{label}|{_format(value)}")
        out = []
        for c, k in zip(reversed(value), reversed(kinds), strict=True):
            if k:
                x, d = divmod(x, len(k))
                c = k[d]
            out.append(c)
        return "".join(reversed(out))


def _root(n: int) -> int:
    r = 1 << (n.bit_length() + 1) // 2
    while (s := (r + n // r) // 2) < r:
        r = s
    return r


def _format(value: str) -> str:
    return "".join("9" if c in DIGITS else "a" if c in LOWER else "A" if c in UPPER else c for c in value)


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in value)


def _only(value: str) -> str:
    return "".join(c for c in value if c in DIGITS)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _card(value: str, f: Feistel) -> str | None:
    d = _only(value)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    # the first digit (the network) stays
    body = f"{f.permute(int(d[1:-1]), 10 ** (len(d) - 2), f'card{len(d)}{d[0]}'):0{len(d) - 2}d}"
    return _refill(value, d[0] + body + str(luhn(d[0] + body)))


def _address(value: str, f: Feistel) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, "ip")
    return ".".join(str(x >> 8 * (3 - i) & 255) for i in range(4))


def _phone(value: str, f: Feistel) -> str | None:
    d = _only(value)
    national = re.fullmatch(r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}", value)
    if national:
        area, middle = d[-10:-7], d[-7:-4]
        if area[0] in "01" or middle[0] in "01":
            # no number of the plan, but written as one: it stays among those
            if value[0] not in "+(":
                return None
            x = int(d[-10:])
            while True:
                x = f.permute(x, 10**10, "phone0")
                new = f"{x:010d}"
                if new[0] in "01" or new[3] in "01":
                    return _refill(value, d[:-10] + new)
        x = (int(area) - 200) * 8_000_000 + (int(middle) - 200) * 10_000 + int(d[-4:])
        x = f.permute(x, 6_400_000_000, "phone1")
        area, rest = divmod(x, 8_000_000)
        return _refill(value, d[:-10] + f"{area + 200}{rest // 10_000 + 200}{rest % 10_000:04d}")
    if value[0] != "+" or not 8 <= len(d) <= 15:
        return None
    # country codes have at most three digits; they stay
    return _refill(value, d[:3] + f"{f.permute(int(d[3:]), 10 ** (len(d) - 3), f'phone{d[:3]}|{len(d)}'):0{len(d) - 3}d}")


def _ssn(value: str, f: Feistel) -> str | None:
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(value: str, f: Feistel) -> str | None:
    """Groups that follow without being part of the number are left as they are."""
    groups = value.split(" ")
    for k in range(len(groups), 0, -1):
        if new := _whole_iban(" ".join(groups[:k]), f):
            return " ".join([new, *groups[k:]])
    return None


def _whole_iban(value: str, f: Feistel) -> str | None:
    raw = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = f.text(raw[4:], f"iban{raw[:2]}")
    new = iter(f"{raw[:2]}{98 - number(body + raw[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in value)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(year: int, month: int, day: int, f: Feistel) -> tuple[int, int, int] | None:
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= x <= _LAST:
        return None
    d = datetime.date.fromordinal(_FIRST + f.permute(x - _FIRST, _LAST - _FIRST + 1, "date"))
    return d.year, d.month, d.day


def _iso_date(value: str, f: Feistel) -> str | None:
    d = _date(int(value[:4]), int(value[5:7]), int(value[8:]), f)
    return d and f"{d[0]:04d}{value[4]}{d[1]:02d}{value[7]}{d[2]:02d}"


def _other_date(value: str, f: Feistel) -> str | None:
    """Day first with dots, month first with slashes, if that is a date; else the other way."""
    sep = value[2]
    a, b, year = int(value[:2]), int(value[3:5]), int(value[6:])
    for flip in ((False, True) if sep == "." else (True, False)):
        day, month = (b, a) if flip else (a, b)
        if d := _date(year, month, day, f):
            x, y = (d[1], d[2]) if flip else (d[2], d[1])
            return f"{x:02d}{sep}{y:02d}{sep}{d[0]:04d}"
    return None


def _mail(value: str, f: Feistel) -> str | None:
    name, _, host = value.rpartition("@")
    return f"{f.text(name, 'mail|' + host.lower())}@{host}"


def _secret(prefix: str) -> Callable[[str, Feistel], str]:
    def run(value: str, f: Feistel) -> str:
        return value[: len(prefix)] + f.text(value[len(prefix) :], "secret")

    return run


def _hex(value: str, f: Feistel) -> str:
    """A hexadecimal secret stays one of the same length and case."""
    n = len(value)
    out = f"{f.permute(int(value, 16), 16**n, 'hex'):0{n}x}"
    return out.upper() if value.upper() == value and value.lower() != value else out


def _assigned(value: str, f: Feistel) -> str:
    """The value of name=value or name: value, in quotes or not."""
    m = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\"'\s=:]+)", value, re.S)
    head, secret = m[1], m[2]
    return head + (_hex(secret, f) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", secret) else f.text(secret, "secret"))


#: (kind, pattern, pseudonym or None where the value isn't valid), in the order of preference at one place.
KINDS: list[tuple[str, str, Callable[[str, Feistel], str | None]]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}", _mail),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", _secret("AKIA")),
    ("token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}(?![A-Za-z0-9])", _secret("ghp_")),
    ("token3", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9]{16,}(?![A-Za-z0-9])", _secret("sk-")),
    ("assigned", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth))\s?[=:]\s?[\"']?[A-Za-z0-9+/_\-.!$%]{6,}", _assigned),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d.-])(?:19|20)\d{2}([-/])\d{2}\1\d{2}(?![\d-])", _iso_date),
    ("date2", r"(?<![\d./])\d{2}([./])\d{2}\1(?:19|20)\d{2}(?![\d/])", _other_date),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _address),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"(?<!\d)\d{13,19}(?!\d)|(?<![\d-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\d-])|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])", _card),
    ("phone", r"(?<![\w+])(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}(?!\d)|(?<![\w+])\+\d(?:[\s.()-]{0,2}\d){7,14}(?!\d)", _phone),
]
#: What a text has to hold for a kind to occur in it; the rest have a digit.
_NEEDS = {"email": "@", "key": "AKIA", "token": "gh", "token3": "sk-", "assigned": "=:"}
_DIGIT = re.compile(r"\d")
_PATTERNS = [(kind, re.compile(p), f) for kind, p, f in KINDS]
#: Public names of the kinds that several patterns share.
_SHOWN = {"token3": "token", "date2": "date", "assigned": "secret"}


@lru_cache(4)
def _cipher(key: str) -> Feistel:
    return Feistel(key)


def pseudonymize(text: str, key: str) -> tuple[str, Counter]:
    """The text with pseudonyms, and how many values of each kind were replaced.

    Kinds that stand earlier in ``KINDS`` win where matches overlap; of one kind the
    first wins. Invalid values (wrong check digit, impossible date) are left alone.
    """
    digit = _DIGIT.search(text) is not None
    kinds = [
        x for x in _PATTERNS
        if ((need := _NEEDS.get(x[0])) is None and digit) or (need == "=:" and ("=" in text or ":" in text)) or (need and need in text)
    ]
    if not kinds:
        return text, Counter()
    f = _cipher(key)
    taken: list[tuple[int, int, str]] = []
    found: Counter = Counter()
    covered = bytearray(len(text))
    for kind, pattern, replace in kinds:
        for m in pattern.finditer(text):
            if any(covered[m.start() : m.end()]):
                continue
            new = replace(m[0], f)
            if new is not None:
                taken.append((m.start(), m.end(), new))
                covered[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found[_SHOWN.get(kind, kind)] += 1
    parts, at = [], 0
    for a, b, new in sorted(taken):
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), found


def _run(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column(1).to_pylist():
                new, found = (None, Counter()) if text is None else pseudonymize(text, key)
                texts.append(new)
                counts.append(sum(found.values()))
                kinds.append(",".join(f"{k}={found[k]}" for k in sorted(found)))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_values", "kinds"])

    return run


def pseudonyms(docs: DataFrame, key: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, text, n_values, kinds`` of each row: the whole text with pseudonyms.

    A null text stays null, an empty one empty, both with no values. Other columns
    are ignored; repeated rows give repeated results, no rows none. ``key`` is the secret,
    and has no default: whoever has it can restore the values.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _run(key), "doc_id long, text string, n_values long, kinds string"
    )
