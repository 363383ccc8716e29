"""Pseudonyms of long values and long texts, and the whole query against a plain second finder."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

from plumbline.llm import pseudonyms as p

KEY = hashlib.blake2b(b"k", digest_size=32).digest()
PLAIN = {  # the same formats without possessive runs or look-behinds for speed
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
}


def test_digits_are_permuted_one_to_one():
    for sizes in ([2, 3, 5], [10, 10], [26, 2, 2, 3], [36]):
        rows = list(itertools.product(*map(range, sizes)))
        assert sorted(tuple(p.permute_digits(list(r), sizes, KEY, "t")) for r in rows) == rows


def test_every_part_of_a_long_secret_changes():
    rng = random.Random(1)
    for n in (65, 128, 256, 257, 4096, 100_000):
        for text in ("deadbeefcafebabe0123456789abcdef" * (n // 32 + 1), "".join(rng.choice("0123456789abcdef") for _ in range(n)), "0" * n):
            text = text[:n]
            made = p.secret(text, KEY)
            same = [a == b for a, b in zip(text, made, strict=True)]
            assert len(made) == n and set(made.lower()) <= set("0123456789abcdef") and p.secret(text, KEY) == made
            for part in range(0, n, 64):  # a sixteenth stays by chance
                assert sum(same[part : part + 64]) <= 18
            other = p.secret(text[:-1] + ("1" if text[-1] == "0" else "0"), KEY)
            assert sum(a == b for a, b in zip(made, other, strict=True)) < n / 4 + 8


def test_addresses_of_every_length_in_time():
    began = time.time()
    for n in range(1, 201):
        text = "abcdefghijklmnopqrstuvwxyz"[n % 26] * n + "@example.org"
        made = p.email(text, KEY)
        assert len(made) == len(text) and made.endswith("@example.org")
        assert n < 8 or sum(a == b for a, b in zip(made[:n], text[:n], strict=True)) < n / 4 + 6
    assert p.permute(5, 26**41, KEY, "t") < 26**41 and time.time() - began < 10


def test_long_texts_are_linear():
    found = p.finder(tuple(p.KINDS))
    by = {k: f for k, _, f in found}
    memo = lambda k, v: by[k](v, KEY)
    for text in ("x" * 5_000_000, "ab.c-d_" * 300_000, "0123456789abcdef" * 60_000 + "g", "1-" * 500_000, "a@" * 300_000, "@a.b" * 200_000, "+1 " * 300_000):
        began = time.time()
        p.replace(text, found, memo)
        assert time.time() - began < 20, text[:10]
    many = " ".join(f"name{i}@mail.org 2001-02-{i % 28 + 1:02d}" for i in range(50_000))
    began = time.time()
    _, spans = p.replace(many, found, memo)
    assert len(spans) > 99_000 and time.time() - began < 30


def plain_replace(text: str) -> tuple[str, int]:
    """Kind after kind, every match that touches no earlier one, by marking characters."""
    taken, new = [False] * len(text), {}
    for kind, (pattern, make) in p.KINDS.items():
        for m in re.finditer(PLAIN.get(kind, pattern), text, re.ASCII):
            made = None if any(taken[m.start() : m.end()]) else make(m[0], KEY)
            if made is not None and made != m[0]:
                taken[m.start() : m.end()] = [True] * len(m[0])
                new[m.start()] = (m.end(), made)
    out, at = [], 0
    while at < len(text):
        to, made = new.get(at, (at + 1, text[at]))
        out.append(made)
        at = to
    return "".join(out), len(new)


def test_the_query_is_that_of_a_plain_finder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["a.b+c@x-y.co.uk, (555) 123-4567 +49 170 1234567", "4111 1111 1111 1111 / 123-45-6789", "1.2.3.4 1850-02-03 0999-12-31 31/12/2099", "..q@w.ee@r.tt", "f" * 31 + " " + "F" * 64, "DE89370400440532013000", None, ""]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(10_000_000 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in p.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got == {i: (None, 0) if t is None else plain_replace(t) for i, t in rows}
    assert sum(n for _, n in got.values()) > 30


def test_days_of_all_years():
    days = [f"{y:04d}-03-01" for y in range(1, 9999, 7)]
    made = [p.date(d, KEY) for d in days]
    assert len(set(made)) == len(days) and all(("1900" <= d[:4] <= "2099") == ("1900" <= m[:4] <= "2099") and len(m) == 10 for d, m in zip(days, made, strict=True))
