"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Method: a value is found by its pattern, validated (check digits, number ranges, calendar), read as a number
below the size of its format, permuted there by a Feistel network with keyed round functions and cycle
walking, and written back in the format it had. The permutation depends on the key and the kind only, so
equal values get equal pseudonyms in all documents, different values different ones, and the holder of the
key can undo it (``Permutation.back``). Values that fail validation are left alone.

Scale: a map over the texts without a shuffle or state; only texts with a digit or ``@`` reach Python's
regular expressions.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.text import slices

ROUNDS = 10
HEX = "0123456789abcdef"
UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY_ID = "(?:AKIA|ASIA)[0-9A-Z]{16}"
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    def __init__(self, key: bytes, kind: str, size: int) -> None:
        self.size = size
        self.left = isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.state = hashlib.blake2b(f"{kind}:{size}".encode(), key=hashlib.sha256(key).digest(), digest_size=40)

    def _round(self, number: int, half: int) -> int:
        state = self.state.copy()
        state.update(f":{number}:{half}".encode())
        return int.from_bytes(state.digest(), "big")

    def _once(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for number in range(0, ROUNDS, 2):
            a = (a + self._round(number, b)) % self.left
            b = (b + self._round(number + 1, a)) % self.right
        return a * self.right + b

    def _undo(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for number in range(ROUNDS - 2, -1, -2):
            b = (b - self._round(number + 1, a)) % self.right
            a = (a - self._round(number, b)) % self.left
        return a * self.right + b

    def __call__(self, value: int) -> int:
        value = self._once(value)
        while value >= self.size:  # walk the cycle back into the domain
            value = self._once(value)
        return value

    def back(self, value: int) -> int:
        value = self._undo(value)
        while value >= self.size:
            value = self._undo(value)
        return value


Permute = Callable[[str, int, int], int]


def refill(shape: str, digits: str) -> str:
    """Put digits into the places of the digits of ``shape``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def luhn(body: str) -> int:
    """The check digit that makes ``body`` valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


def card(found: re.Match, permute: Permute) -> str | None:
    digits = only_digits(found[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(permute("card", 10 ** (len(digits) - 1), int(digits[:-1]))).zfill(len(digits) - 1)
    return refill(found[0], body + str(luhn(body)))


def mod97(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def iban(found: re.Match, permute: Permute) -> str | None:
    plain = found[0].replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or int(check) != 98 - mod97(country, body):
        return None
    body = mixed("iban " + country, body, permute)
    rest = iter(f"{country}{98 - mod97(country, body):02d}{body}")
    return "".join(c if c == " " else next(rest) for c in found[0])


def ssn(found: re.Match, permute: Permute) -> str | None:
    area, group, serial = (int(x) for x in found[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    value = permute("ssn", 898 * 99 * 9999, (place * 99 + group - 1) * 9999 + serial - 1)
    value, serial = divmod(value, 9999)
    place, group = divmod(value, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(found: re.Match, permute: Permute) -> str | None:
    """North American numbers keep their shape rules; others keep the first two digits after the plus."""
    digits = only_digits(found[0])
    head = len(digits) - 10
    if head in (0, 1) and (not head or digits[0] == "1") and digits[head] > "1" and digits[head + 3] > "1":
        area, office, line = int(digits[head : head + 3]), int(digits[head + 3 : head + 6]), int(digits[head + 6 :])
        value = permute("phone", 800 * 800 * 10_000, ((area - 200) * 800 + office - 200) * 10_000 + line)
        value, line = divmod(value, 10_000)
        area, office = divmod(value, 800)
        return refill(found[0], f"{digits[:head]}{area + 200}{office + 200}{line:04d}")
    if found[0][0] == "+" and 8 <= len(digits) <= 15:
        size = len(digits) - 2
        return refill(found[0], digits[:2] + str(permute("phone " + digits[:2], 10**size, int(digits[2:]))).zfill(size))
    return None


def address(found: re.Match, permute: Permute) -> str | None:
    parts = [int(x) for x in found[0].split(".")]
    if max(parts) > 255:
        return None
    value = permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def date(found: re.Match, permute: Permute) -> str | None:
    """Year-month-day, or day and month before the year; a first part above 12 decides, else the day is first."""
    fields = re.split(r"([-/.])", found[0])
    numbers = [int(x) for x in fields[::2]]
    order = [0, 1, 2] if len(fields[0]) == 4 else [2, 1, 0] if numbers[1] <= 12 else [2, 0, 1]
    try:
        day = datetime.date(*(numbers[i] for i in order)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permute("date", DAYS, day))
    out = [""] * 3
    for i, part in zip(order, (new.year, new.month, new.day)):
        padded = len(fields[2 * i]) > 1 and (fields[2 * i][0] == "0" or any(f[0] == "0" for f in fields[::2]) or len(fields[0]) == 4)
        out[i] = f"{part:02d}" if padded and i != order[0] else f"{part:04d}" if i == order[0] else str(part)
    return fields[1].join(out)


_RADIX = [("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26)]


def mixed(kind: str, text: str, permute: Permute, digits: str | None = None) -> str:
    """Permute letters and digits in their places, each within its class (or all within ``digits``)."""
    classes = [(digits, len(digits))] if digits else _RADIX
    places = [(i, chars, radix) for i, c in enumerate(text) for chars, radix in classes if c in chars]
    value, size = 0, 1
    for i, chars, radix in places:
        value, size = value * radix + chars.index(text[i]), size * radix
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))) if not digits else str(len(text))
    value = permute(f"{kind} {shape}", size, value)
    out = list(text)
    for i, chars, radix in reversed(places):
        value, rest = divmod(value, radix)
        out[i] = chars[rest]
    return "".join(out)


def email(found: re.Match, permute: Permute) -> str | None:
    """Local part and host together; the last label stays."""
    stem, dot, last = found[0].rpartition(".")
    return mixed("email", stem, permute) + dot + last


def secret(found: re.Match, permute: Permute) -> str | None:
    """A value after its label gets the pseudonym that it has without one."""
    value = found["value"]
    if re.fullmatch(KEY_ID, value):
        return found["label"] + value[:4] + mixed("key", value[4:], permute, UPPER)
    digits = HEX if re.fullmatch("[0-9a-f]{12,}", value) else None
    return found["label"] + mixed("hex" if digits else "secret", value, permute, digits)


def access_key(found: re.Match, permute: Permute) -> str | None:
    return found[0][:4] + mixed("key", found[0][4:], permute, UPPER)


def hexadecimal(found: re.Match, permute: Permute) -> str | None:
    return mixed("hex", found[0], permute, HEX)


_D = r"(?<![\w.+@-])"
_E = r"(?![\w@]|[.-]\d)"
KINDS: dict[str, tuple[re.Pattern, Callable[[re.Match, Permute], str | None]]] = {
    "secret": (re.compile(r"(?P<label>\b(?:password|passwd|pwd|secret|api[_-]?key|token)\s*[=:]\s*[\"']?)(?P<value>(?=[\w./+-]*\d)[\w./+-]{6,})", re.I | re.A), secret),
    "email": (re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.%+-]*\w)?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.A), email),
    "access_key": (re.compile(rf"\b{KEY_ID}\b", re.A), access_key),
    "hex": (re.compile(r"\b(?=[a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b", re.A), hexadecimal),
    "iban": (re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.A), iban),
    "address": (re.compile(_D + r"\d{1,3}(?:\.\d{1,3}){3}" + _E, re.A), address),
    "date": (re.compile(_D + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})" + _E, re.A), date),
    "card": (re.compile(_D + r"\d(?:[ -]?\d){12,18}" + _E, re.A), card),
    "ssn": (re.compile(_D + r"\d{3}-\d{2}-\d{4}" + _E, re.A), ssn),
    "phone": (re.compile(r"(?<![\w.@-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _E + r"|(?<![\w.@-])\+\d{1,3}(?:[ .()-]{0,2}\d){6,14}" + _E, re.A), phone),
}


def replaced(text: str, permute: Permute) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, first, last) of each value in the original text.

    Kinds are tried in the order of ``KINDS``; a range belongs to the first kind that validates it.
    """
    taken: list[tuple[int, int, str, str]] = []
    for kind, (pattern, write) in KINDS.items():
        for found in pattern.finditer(text):
            a, b = found.span()
            at = bisect(taken, (b,))
            if at and taken[at - 1][1] > a:
                continue
            new = write(found, permute)
            if new is not None:
                taken.insert(at, (a, b, kind, new))
    if not taken:
        return text, []
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in taken]


def permuter(key: bytes) -> Permute:
    @lru_cache(4096)
    def made(kind: str, size: int) -> Permutation:
        return Permutation(key, kind, size)

    return lambda kind, size, value: made(kind, size)(value)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_replaced, spans)`` per row: the text with pseudonyms and where values stood.

    ``spans`` holds kind and code point range in the original text. Null texts stay null, empty texts
    empty; null ids and repeated rows are treated like any row. An empty table gives no row; other columns
    are ignored. Dates from 1900 to 2099 are covered.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = permuter(key)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                likely = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
                at = np.flatnonzero(likely.to_numpy(zero_copy_only=False))
                done = [replaced(t, permute) for t in texts.take(pa.array(at)).to_pylist()]
                spans: list[list] = [[] for _ in range(len(texts))]
                for i, (_, found) in zip(at, done):
                    spans[i] = [{"kind": k, "first": a, "last": b} for k, a, b in found]
                fresh = pc.replace_with_mask(texts, likely, pa.array([t for t, _ in done], pa.string()))
                counts = pa.array([len(s) for s in spans], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), fresh, counts, pa.array(spans, SPANS)], ["doc_id", "text", "n_replaced", "spans"])

    return docs.mapInArrow(run, "doc_id bigint, text string, n_replaced int, spans array<struct<kind:string,first:int,last:int>>")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, under an example key."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), b"example key, to be replaced by a secret one")
