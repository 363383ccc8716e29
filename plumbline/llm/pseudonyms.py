"""Format-preserving pseudonyms for personal data (operator 3).

Numbers, dates and addresses are found by pattern, validated, and replaced by another value of
the same format: a keyed Feistel permutation of the format's values.  Equal values get equal
pseudonyms in every document, and different ones different ones.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 10
#: Letters and digits beyond which a value is permuted digit by digit, not as one number.
LONG = 20
#: Characters beyond which a value's pseudonym is not kept for its next occurrence.
KEPT = 200
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: an alternating Feistel over a x b >= size, walked until inside."""
    if size < 2:
        return value
    a = max(2, math.isqrt(size - 1) + 1)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _round(key, tweak, size, r, left)) % b
            else:
                left = (left + _round(key, tweak, size, r, right)) % a
        value = left * b + right
        if value < size:
            return value


def _round(key: bytes, tweak: str, size: int, r: int, half: int) -> int:
    """A keyed number with 64 bits more than either half has."""
    said = f"{tweak}|{size:x}|{r}|{half:x}".encode()
    width = max(16, size.bit_length() // 16 + 10)
    if width <= 64:
        return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=width).digest(), "big")
    return int.from_bytes(hashlib.shake_256(key + said).digest(width), "big")


def _shifts(key: bytes, tweak: str, r: int, half: np.ndarray, n: int) -> np.ndarray:
    """``n`` keyed numbers of 32 bits from a half's digits."""
    return np.frombuffer(hashlib.shake_256(key + f"{tweak}|{r}|".encode() + half.tobytes()).digest(4 * n), "<u4").astype(np.int64)


def permute_digits(digits: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all rows of digits below ``sizes``: an alternating Feistel between the row's halves.

    Every digit of a half is shifted by its own part of a keyed stream that the other half
    sets, so time is linear in the row and no digit stays by rule.
    """
    d, s = np.array(digits, np.int64), np.array(sizes, np.int64)
    h = len(d) // 2
    for r in range(ROUNDS):
        own, other = (slice(None, h), slice(h, None)) if r % 2 == 0 else (slice(h, None), slice(None, h))
        d[own] = (d[own] + _shifts(key, tweak, r, d[other].astype("<i8"), len(d[own]))) % s[own]
    return d.tolist()


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: k for k in _CLASSES for c in k}


def permute_text(text: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """Permute the letters and digits of ``text`` among texts with the same classes in the same places."""
    places = [(c, (alphabet if alphabet and c in alphabet else _CLASS.get(c))) for c in text]
    shape = "".join("." if k is None else k[0] for _, k in places)
    fixed = "".join(c for c, k in places if k is None)
    tweak = f"{tweak}|{shape}|{fixed}"
    classes = [k for _, k in places if k]
    digits = [k.index(c) for c, k in places if k]
    if len(digits) > LONG:
        tweak = hashlib.blake2b(tweak.encode(), digest_size=16).hexdigest()
        digits = permute_digits(digits, [len(k) for k in classes], key, tweak)
    elif digits:
        size, value = math.prod(len(k) for k in classes), 0
        for d, k in zip(digits, classes, strict=True):
            value = value * len(k) + d
        made = permute(value, size, key, tweak)
        for i in range(len(digits) - 1, -1, -1):
            made, digits[i] = divmod(made, len(classes[i]))
    made = iter([k[d] for d, k in zip(digits, classes, strict=True)])
    return "".join(c if k is None else next(made) for c, k in places)


def _digits(text: str, made: str) -> str:
    """``text`` with its digits replaced in turn."""
    it = iter(made)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in text)


def _number(text: str, key: bytes, tweak: str, valid: Callable[[str], bool] | None = None, fixed: int = 0) -> str:
    digits = re.sub(r"[^0-9]", "", text)
    head, tail = digits[:fixed], digits[fixed:]
    while True:
        tail = permute_text(tail, key, f"{tweak}|{head}")
        if valid is None or valid(head + tail):
            return _digits(text, head + tail)


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits: those with a valid check digit keep one; the rest are permuted among the invalid."""
    digits = re.sub(r"[^0-9]", "", text)
    if not 13 <= len(digits) <= 19:
        return None
    body, ok = digits[:-1], int(digits[-1]) == luhn(digits[:-1])
    if ok:
        body = permute_text(body, key, "card")
        return _digits(text, body + str(luhn(body)))
    made = permute_text(body, key, "account")
    offset = (int(digits[-1]) - luhn(digits[:-1])) % 10
    return _digits(text, made + str((luhn(made) + offset) % 10))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(text: str, key: bytes) -> str | None:
    """ddd-dd-dddd with no zero group and a first group that is in use."""
    return _number(text, key, "ssn", _ssn_ok) if _ssn_ok(re.sub(r"[^0-9]", "", text)) else None


def phone(text: str, key: bytes) -> str | None:
    """An international number of 8 to 15 digits; the country code stays."""
    digits = re.sub(r"[^0-9]", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    return _number(text, key, "phone", fixed=len(digits) - 10 if len(digits) > 10 else 0)


def ip(text: str, key: bytes) -> str | None:
    """A dotted quad of octets up to 255, without leading zeros."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    made = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, made.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    """A calendar date: y-m-d, or d.m.y and m/d/y, each among its own format, and from 1900 to 2099 among these years."""
    m = re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})", text)
    if not m:
        return None
    if m[1]:
        y, mo, d, sep, form = int(m[1]), int(m[3]), int(m[4]), m[2], "ymd"
    elif m[6] == "/":
        mo, d, y, sep, form = int(m[5]), int(m[7]), int(m[8]), m[6], "mdy"
    else:
        d, mo, y, sep, form = int(m[5]), int(m[7]), int(m[8]), m[6], "dmy"
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    n = LAST_DAY - FIRST_DAY + 1
    if FIRST_DAY <= day <= LAST_DAY:
        made = FIRST_DAY + permute(day - FIRST_DAY, n, key, "date")
    else:  # the days before and after, as one row
        made = 1 + permute(day - 1 if day < FIRST_DAY else day - 1 - n, datetime.date.max.toordinal() - n, key, "far date")
        made += n if made >= FIRST_DAY else 0
    at = datetime.date.fromordinal(made)
    wide = len(text) == 10
    f = (lambda v: f"{v:02d}") if wide else str
    year = f"{at.year:04d}"
    return {"ymd": f"{year}{sep}{f(at.month)}{sep}{f(at.day)}", "mdy": f"{f(at.month)}{sep}{f(at.day)}{sep}{year}", "dmy": f"{f(at.day)}{sep}{f(at.month)}{sep}{year}"}[form]


def iban(text: str, key: bytes) -> str | None:
    """An account number with valid mod-97 check digits; country and classes stay, the check is made anew."""
    plain = text.replace(" ", "")
    rest = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if rest(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_text(plain[4:], key, f"iban|{plain[:2]}")
    made = plain[:2] + f"{98 - rest(body + plain[:2] + '00'):02d}" + body
    it = iter(made)
    return "".join(c if c == " " else next(it) for c in text)


def email(text: str, key: bytes) -> str | None:
    """The part before the at sign, by character classes; the domain stays."""
    local, _, domain = text.rpartition("@")
    return f"{permute_text(local, key, 'email|' + domain.lower())}@{domain}"


def secret(text: str, key: bytes) -> str | None:
    """A hexadecimal token of 32 digits or more."""
    return permute_text(text, key, "secret", "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef")


#: kind -> (pattern, pseudonym or None if not valid), first match first.  A group v is the value, else the match
#: is; runs of unknown length are entered at their start alone and not given back, so a search is linear.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<v>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", email),
    "secret": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?![\w])|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])", phone),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!(?!T\d\d:)\w|[/-])", date),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", ip),
    "card": (r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", card),
}


def finder(kinds: tuple[str, ...]) -> list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]]:
    """Patterns of the kinds; digits and letters are ASCII ones, the only ones that formats are made of."""
    return [(k, re.compile(KINDS[k][0], re.ASCII), KINDS[k][1]) for k in kinds]


def replace(text: str, found: list, memo: Callable[[str, str], str | None]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of each value in the original, in order."""
    spans: list[tuple[int, int, str, str]] = []
    for kind, pattern, _ in found:
        new, i = [], 0
        for m in pattern.finditer(text):
            begin, end = m.span("v" if "v" in pattern.groupindex else 0)
            while i < len(spans) and spans[i][1] <= begin:
                i += 1
            if i < len(spans) and spans[i][0] < end:
                continue
            value = text[begin:end]
            made = memo(kind, value)
            if made is not None and made != value:
                new.append((begin, end, kind, made))
        spans = sorted(spans + new)
    out, at = [], 0
    for a, b, _, made in spans:
        out += [text[at:a], made]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in spans]


def pseudonymise(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Replace personal data by pseudonyms of the same format.

    Returns doc_id, text, n_replaced and spans (kind, begin, end in characters of the
    original), one row per row of ``docs``.  A null text stays null with no spans; a text
    without such data is unchanged; null doc_ids are carried; equal texts get equal results;
    empty ``docs``: no rows.  A value whose pseudonym is by chance itself is not counted.  Values that do not validate (a wrong check digit in an
    account number, an impossible date or octet) are left, but for long digit runs, which are
    permuted among those that do not validate either.  Values and texts may be of any length;
    time is linear in them.  Keep ``key`` secret and the same for
    all documents that must stay linked.  Other columns are ignored.
    """
    secret_key = hashlib.blake2b(key.encode(), digest_size=32).digest()
    schema = "doc_id long, text string, n_replaced long, spans array<struct<kind:string,begin:int,end:int>>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder(kinds)
        by_kind = {k: f for k, _, f in found}
        quick = re.compile(r"[0-9]|@|[A-Fa-f]{32}")

        @lru_cache(maxsize=50_000)
        def short(kind: str, value: str) -> str | None:
            return by_kind[kind](value, secret_key)

        def memo(kind: str, value: str) -> str | None:
            return short(kind, value) if len(value) <= KEPT else by_kind[kind](value, secret_key)

        for batch in slices(batches):
            texts, n, spans = [], [], []
            for text in batch.column("text").to_pylist():
                made, marks = (text, []) if text is None or not quick.search(text) else replace(text, found, memo)
                texts.append(made)
                n.append(len(marks))
                spans.append([{"kind": k, "begin": a, "end": b} for k, a, b in marks])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_replaced", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms in all documents, by the key set as ``spark.plumbline.pseudonymKey``."""
    key = spark.conf.get("spark.plumbline.pseudonymKey", "a public key, for tests alone")
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
