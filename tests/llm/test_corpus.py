"""Corpus operators against brute force, round trips and planted cases, with odd rows throughout."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, langid, linerules, minmax, mixing, packing, ppm, pseudonyms, suffix, superkmer
from plumbline.llm.common import gram_hash, sliding_min, span_hash
from plumbline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo") for b in ("ra", "so", "tu") for c in ("n", "st", "x", "é")]


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogateescape") for w in (text or "").encode().split()]


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, empty, null, tiny and long ones, and one repeated row."""
    rng = random.Random(7)
    draw = lambda n: [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    passage, base = draw(70), draw(120)
    texts: list[str | None] = [None, "", "  \n\t ", "One", "two words here", " ".join(base), " ".join(base), " ".join(base[:60] + ["zzz"] + base[61:])]
    texts += [" ".join(draw(30) + passage + draw(25)) for _ in range(6)]
    texts += [" ".join(draw(rng.randrange(1, 160))) for _ in range(12)]
    texts += [" ".join(["la"] * 90), "la " * 140, " ".join(draw(1500)), " ".join(draw(60)), "Größe ÉTÉ naïve " * 20]
    texts += [" ".join(base[: 120 - k] + draw(k)) for k in range(1, 14)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def texts_of(rows: list[tuple]) -> list[tuple[int, str]]:
    return [(r[0], r[1] or "") for r in rows]


def test_hash_does_not_depend_on_place():
    a = np.frombuffer(b"xxhello worldhello", np.uint8)
    h = span_hash(a, np.array([2, 13]), np.array([7, 18]))
    assert h[0] == h[1] and span_hash(a, np.array([2]), np.array([8]))[0] != h[0]
    t = np.arange(2_000_000, dtype=np.uint64) % np.uint64(1000)
    g = gram_hash(t, 5)
    assert (g[:1000] == g[1_000_000:1_001_000]).all()


def test_sliding_min_is_leftmost():
    g = np.array([5, 1, 1, 7, 0, 9, 9], np.uint64) << np.uint64(20)
    assert sliding_min(g, 3).tolist() == [1, 1, 4, 4, 4]


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_dedup(docs, hot):
    got = sorted((r[0], r[1], r[2], r[4]) for r in superkmer.dedup_windows(docs, 50, 10, hot).collect())
    rows = texts_of(corpus())
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogateescape")).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(docs, hot):
    got = sorted(tuple(r) for r in suffix.dedup_bytes(docs, 200, 40, hot).collect())
    rows = [(d, t.encode()) for d, t in texts_of(corpus())]
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)


def test_suffix_order_is_lexicographic():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40, 90))) for _ in range(30)] + [b"a" * 80, b"ab" * 40]
    counts = suffix.repeated(strings, np.zeros(len(strings), np.int64), np.ones(len(strings), np.int64), 24)
    seen = Counter(s[i : i + 24] for s in strings for i in range(len(s) - 23))
    assert [c.tolist() for c in counts] == [[seen[s[i : i + 24]] for i in range(len(s) - 23)] for s in strings]


def shingles(text: str, n: int = 5) -> set[tuple]:
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows: list[tuple[int, str]], percent: int) -> dict[int, int]:
    sets = [(d, shingles(t)) for d, t in rows]
    top = {d: d for d, _ in rows}

    def find(a: int) -> int:
        while top[a] != a:
            a = top[a]
        return a

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            top[q] = p
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_near_duplicates(docs, threshold):
    rows = texts_of(corpus())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(docs, threshold).collect()}
    comp = brute_components(rows, round(100 * threshold))
    assert got == {d: (len(shingles(t)), comp[d], comp[d] == d) for d, t in rows}


def test_near_duplicates_beyond_the_centre(spark):
    """Chains and members that the central document does not link, in blocks of two."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:a] + [f"x{i}"] + base[a + 1 :])) for i, a in enumerate(range(2, 98, 4))]
    rows += [(100 + i, " ".join(base[:a] + [f"y{i}a", f"y{i}b"] + base[a + 2 : b] + [f"z{i}"] + base[b + 1 :])) for i, (a, b) in enumerate([(10, 60), (10, 80), (30, 70)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(df, 0.85).collect()}
    assert got == brute_components(rows, 85)
    rest = df.select(F.lit(1).cast("long").alias("bucket"), "doc_id", F.col("doc_id").alias("component"), F.lit(True).alias("odd"))
    signed = minmax.signatures(df, 5, minmax.band_rows(0.85))
    links = {tuple(sorted(r)) for r in minmax.rest_links(rest, signed, df, 5, 85, block=2).collect()}
    found = brute_components(rows, 85)
    assert all(found[a] == found[b] for a, b in links)
    joined = {r["id"]: r["component"] for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert all(joined.get(d, d) == c for d, c in found.items())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def item_words(text: str | None) -> list[str]:
    out, now = [], ""
    for c in low(text or ""):
        if c.isascii() and not c.isalnum():
            out, now = [*out, now], ""
        else:
            now += c
    return [w for w in [*out, now] if w]


def test_decontamination(spark, docs):
    rows = corpus()
    items = [(1, " ".join(rows[8][1].split()[40:75]).upper().replace(" ", ", ")), (2, "two words"), (10, rows[9][1][:30]), (3, None), (4, ""), (5, "not in there at all, nowhere to be found in it"), (2, "two words"), (None, "one")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contained(docs, df).drop("items").collect())
    want = []
    for d, t in texts_of(rows):
        w, hit, which = item_words(t), set(), set()
        for item, it in items:
            iw = item_words(it)
            n = min(10, len(iw))
            if item is None or not n:
                continue
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    which.add(str(item))
        want.append((d, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    clean = decontaminate.without_contaminated(docs, df)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)


def test_decontamination_with_part_of_the_words(spark):
    a = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(a[:5] + ["no"] + a[6:])), (2, " ".join(a[:5] + ["no"] * 6 + a[11:]))], "doc_id long, text string")
    item = spark.createDataFrame([(1, " ".join(a[:10]))], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contained(df, item, 10, 0.9).collect()}
    assert got == {1: True, 2: False}


def test_decontamination_folds_only_ascii(spark):
    """Case of other letters tells words apart, wherever the text puts its separators; hidden columns stay."""
    line = ["ΤΕΛΟΣ", "ΑΡΧΗ", "İstanbul", "K-elvin", "OHM", "Σ", "one"]
    rows = [(1, "x ΤΕΛΟΣ.ΑΡΧΗ İSTANBUL'K;ELVIN ohm Σ,One y"), (2, "ΤΕΛΟΣ ΑΡΧΗ İstanbul \u212a elvin ohm Σ one"), (3, "τελος αρχη İstanbul k elvin ohm σ one"), (4, "ΤΕΛΟΣ ΑΡΧΗ"), (None, "Σ one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("mine"), "h": F.lit(1), "win": F.lit("w"), "key_": F.lit(None).cast("string")})
    items = [(1, " ".join(line)), (2, "Σ"), (3, "ΤΕΛΟΣ"), (4, "Σ one")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contained(df, spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(2)), 8).collect())
    assert got == sorted([("1", 10, 8, ["1", "2", "3", "4"]), ("2", 8, 3, ["2", "3", "4"]), ("3", 8, 0, []), ("4", 2, 1, ["3"]), ("None", 2, 2, ["2", "4"]), ("None", 0, 0, [])])
    clean = decontaminate.without_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), 8)
    assert clean.columns == df.columns and sorted((str(r["doc_id"]), r["key"], r["key_"]) for r in clean.collect()) == [("3", "mine", None), ("None", "mine", None)]


def test_line_rules():
    rules = linerules.Rules()
    fault = lambda t: linerules.line_fault(t.encode(), rules)
    assert fault("This is a plain sentence.") is None
    assert fault("Home | About | Contact us.") == "navigation" and fault("Two words.") == "navigation"
    assert fault("no full stop at the end") == "punctuation" and fault("So! Much! Shouting! Here!") == "punctuation"
    assert fault("All rights reserved by the owner.") == "boilerplate" and fault("a## b$$ c%% d.") == "symbols"


def test_line_cleaning(docs):
    got = {r["doc_id"]: r for r in linerules.clean_lines(docs).collect()}
    for d, t in texts_of(corpus()):
        w, r = words(t), got[d]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(again), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_language(spark):
    rng = random.Random(1)
    make = {"aa": "the of and ing tion ent her was".split(), "bb": "der die und ung keit sch ein ich".split(), "cc": "que los ción mente ado de el as".split()}
    rows = [(i, " ".join("".join(rng.sample(make[k], 2)) for _ in range(40)), k) for i, k in enumerate("aa bb cc".split() * 60)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 -- !", "cc"), (903, rows[1][1], None), (904, "學而時習之 " * 5, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, df.filter(~langid.held_out())).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got.values())
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.97 * len(test)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    left = langid.identified(df)
    assert left.columns == df.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in left.collect())


def test_language_against_brute_force(spark):
    """Predictions and scores from vectors added up one n-gram at a time, short and long texts alike."""
    rng = random.Random(11)
    make = {"aa": "the of and ing", "bb": "der die und ung", "cc": "que los ñon las"}
    rows = [(i, " ".join("".join(rng.sample(make[k].split(), 2)) for _ in range(rng.choice((1, 2, 25)))), k) for i, k in enumerate("aa bb cc".split() * 12)]
    df = spark.createDataFrame([*rows, (90, "x9!", None), (91, "Ünd-die", None)], "doc_id long, text string, lang string")
    space = langid.Space(256, 3)

    def bundle(text: str) -> np.ndarray:
        codes = [0]
        for c in text.lower():
            if c.isalpha() or codes[-1]:
                codes.append(ord(c) if c.isalpha() else 0)
        codes = [*codes, 0] if codes[-1] else codes
        out = np.zeros(256)
        for g in zip(codes, codes[1:], codes[2:]):
            if any(g):
                out += np.prod([np.roll(space.letter(c), i).astype(float) for i, c in enumerate(g)], axis=0)
        return out / max(np.linalg.norm(out), 1e-9)

    proto = np.stack([sum(bundle(t) for _, t, k in rows if k == lang) for lang in make])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    apart = proto - proto.mean(axis=0)
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    for r in langid.identify(df, df.filter("lang IS NOT NULL"), dim=256, keep=["doc_id", "text"]).collect():
        v = bundle(r["text"]) - proto.mean(axis=0)
        cosine = apart @ (v / np.linalg.norm(v))
        assert r["score"] == pytest.approx((1 + cosine.max()) / 2, abs=1e-5) and r["lang_pred"] == list(make)[int(cosine.argmax())]
    with pytest.raises(ValueError, match="name of a result"):
        langid.identify(df, df, keep=["doc_id", "lang_pred"])


def test_bundle_is_the_sum_of_bound_letters():
    space = langid.Space(256, 3)
    (got,) = space.bundles(["Ab, c"])
    want = np.zeros(256)
    t = [0, ord("a"), ord("b"), 0, ord("c"), 0, 0]
    for i in range(4):
        want += space.letter(t[i]).astype(int) * np.roll(space.letter(t[i + 1]), 1) * np.roll(space.letter(t[i + 2]), 2)
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, "c": 100, None: 50})
    assert got["a"] == 30 and abs(sum(got.values()) - 260) < 1e-9 and got[None] == pytest.approx(230 * 5 / 8)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0}


def test_route_prefers_fewer_repeats():
    flow = mixing.route([10, 10], [[0], [0, 1]], [15, 10], 3)
    assert flow[0][0] + flow[1][0] == 15 and flow[1][1] == 10 and max(map(sum, flow)) <= 15


def unit_flow(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int) -> tuple[int, int]:
    """Words routed and their cost, a word at a time over the cheapest path (Bellman-Ford)."""
    n, ends = len(capacity), (len(capacity) + len(quota), len(capacity) + len(quota) + 1)
    arcs = [[ends[0], p, c, 2 * r + 1] for p, c in enumerate(capacity) for r in range(repeats)] + [[p, n + s, 10**9, 0] for p in range(n) for s in member[p]] + [[n + s, ends[1], q, 0] for s, q in enumerate(quota)]
    arcs = [x for a, b, c, w in arcs for x in ([a, b, c, w], [b, a, 0, -w])]
    sent = cost = 0
    while True:
        far, via = {ends[0]: 0}, {}
        for _ in range(ends[1] + 1):
            for k, (a, b, c, w) in enumerate(arcs):
                if c > 0 and a in far and far[a] + w < far.get(b, math.inf):
                    far[b], via[b] = far[a] + w, k
        if ends[1] not in far:
            return sent, cost
        at = ends[1]
        while at != ends[0]:
            arcs[via[at]][2] -= 1
            arcs[via[at] ^ 1][2] += 1
            at = arcs[via[at]][0]
        sent, cost = sent + 1, cost + far[ends[1]]


def test_route_costs_least():
    rng = random.Random(4)
    for _ in range(25):
        ns = rng.randint(1, 4)
        capacity = [rng.randint(0, 7) for _ in range(rng.randint(1, 5))]
        member = [sorted(rng.sample(range(ns), rng.randint(1, ns))) for _ in capacity]
        quota = [rng.randint(0, 20) for _ in range(ns)]
        flow = mixing.route(capacity, member, quota, 3)
        assert all(sum(f) <= 3 * c for f, c in zip(flow, capacity, strict=True))
        into = [sum(f[m.index(s)] for f, m in zip(flow, member, strict=True) if s in m) for s in range(ns)]
        assert all(a <= b for a, b in zip(into, quota, strict=True))
        cost = sum((2 * r + 1) * max(0, min(c, sum(f) - r * c)) for f, c in zip(flow, capacity, strict=True) for r in range(3))
        assert (sum(into), cost) == unit_flow(capacity, member, quota, 3)


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), sorted(rng.sample("abc", rng.randint(1, 3)))) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), by="sources").collect()
    sizes, total = Counter(), sum(len(t.split()) for _, t, _ in rows)
    for _, t, m in rows:
        sizes.update(dict.fromkeys(m, len(t.split())))
    quota = mixing.targets(dict(sizes))
    scale = total / sum(quota.values())
    words_in: dict[tuple, int] = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(sum(quota[s] * scale for s in r["sources"]))
        words_in[tuple(r["sources"])] += r["size"]
    names, patterns = sorted(sizes), sorted(words_in)
    flow = mixing.route([words_in[p] for p in patterns], [[names.index(s) for s in p] for p in patterns], [round(quota[s] * scale) for s in names], 3)
    for p, f in zip(patterns, flow, strict=True):
        assert abs(sum(r["taken"] for r in got if tuple(r["sources"]) == p) - sum(f)) <= 30


def test_mix(docs, spark):
    rows = mixing.mix(docs.drop("size")).collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["size"] == len(words(r["text"]))
    want = mixing.targets({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0]["target"] == pytest.approx(want[s]) and x[0]["source_size"] == sum(r["size"] for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x)
    assert sum(want.values()) == pytest.approx(total)
    again = mixing.mix(docs.drop("size").repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mixed(docs).columns == docs.columns
    many = spark.createDataFrame([(i, "w " * (i + 1), ["a", "b"] if i % 2 else ["b"]) for i in range(30)] + [(99, None, None)], "doc_id long, text string, sources array<string>")
    assert {r["doc_id"] for r in mixing.mix(many, by="sources").collect()} == {*range(30), 99}


def test_segment_tree_finds_the_fullest_bin():
    rng = random.Random(2)
    sizes = np.array([rng.randrange(1, 65) for _ in range(400)])
    which, n = packing.best_fit(sizes, 64)
    used = np.bincount(which, weights=sizes, minlength=n)
    assert used.max() <= 64
    bins: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):  # plain best fit
        fit = [b for b in bins if b >= s]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - s)
        else:
            bins.append(64 - s)
    assert n == len(bins)


def test_packing_round_trip(docs):
    import tiktoken

    encode, end = packing.encoder(packing.VOCABULARY)
    for t in ("a  b   c\n d", " lead", "x\t y", "don't stop", "été là", ""):
        plain = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=_ranks(), special_tokens={}).encode_ordinary(t)
        assert np.frombuffer(encode(t), np.uint16).tolist() == plain
    packed = packing.pack(docs, 128).cache()
    rows = packed.collect()
    for r in rows:
        ids, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 128 and cu[0] == 0 and cu[-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == end).all()
        assert all(pos[a:b].tolist() == list(range(b - a)) for a, b in zip(cu[:-1], cu[1:], strict=True))
    back = Counter((r["doc_id"], bytes(r["ids"])) for r in packing.unpack(packed).collect())
    assert back == Counter((d, encode(t) + np.array([end], np.uint16).tobytes()) for d, t in texts_of(corpus()))


def _ranks() -> dict[bytes, int]:
    import base64

    with open(packing.VOCABULARY, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@pytest.mark.parametrize("group", [ppm.GROUP, 40])
def test_ppm_against_a_trie(docs, group):
    train = F.col("doc_id") % 4 != 2
    got = {r["doc_id"]: r for r in ppm.score(docs, train, 2000, group).collect()}
    k, end = ppm.ORDER, ppm.END
    trie: dict[tuple, Counter] = defaultdict(Counter)
    tokens: Counter = Counter()
    rows = texts_of(corpus())
    for d, t in rows:
        if d % 4 != 2:
            tokens.update([*low(t).encode().split(), None])
            q = [end] * k + list(low(t).encode()) + [end]
            for i in range(k, len(q)):
                for j in range(k + 1):
                    trie[tuple(q[i - j : i])][q[i]] += 1

    def logp(ctx: tuple, s: int) -> float:
        out, excluded = 0.0, set()
        for j in range(k, -1, -1):
            c = trie.get(ctx[k - j :])
            if not c:
                continue
            t, q = sum(v for x, v in c.items() if x not in excluded), sum(x not in excluded for x in c)
            if s in c:
                return out + math.log10((2 * c[s] - 1) / (2 * t))
            if t:
                out += math.log10(q / (2 * t))
            excluded = set(c)
        return out - math.log10(256 - len(excluded))

    n, v = sum(tokens.values()), len(tokens)
    for d, t in rows:
        w = [*low(t).encode().split(), None]
        q = [end] * k + list(low(t).encode()) + [end]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d % 4 == 2, len(w), sum(tokens[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(logp(tuple(q[i - k : i]), q[i]) for i in range(k, len(q))))
    assert sum(10 ** logp(tuple(b"konla")[:k], s) for s in range(256)) == pytest.approx(1)


KEY = b"k" * 32


def test_permutation_and_formats():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(pseudonyms.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))
    made = pseudonyms.card("4111-1111-1111-1111", KEY)
    digits = made.replace("-", "")
    assert made[4] == "-" and int(digits[-1]) == pseudonyms.luhn(digits[:-1]) and made != "4111-1111-1111-1111"
    assert pseudonyms.date("31/02/2020", KEY) is None and pseudonyms.ip("1.2.3.256", KEY) is None
    assert len({pseudonyms.date(f"2020-01-{d:02d}", KEY) for d in range(1, 32)}) == 31


def test_pseudonyms_in_text(spark):
    text = "Call +1 (136) 555-7479 or x.7@mail3.example.com, from 10.1.2.3 on 2024-02-29; card 4111111111111111, twice 4111111111111111."
    rows = [(1, text), (2, "card 4111111111111111 here"), (3, None), (4, ""), (5, "In 2024 we sold 12 of 300, v1.2.3."), (1, text)]
    got = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[3]["text"] is None and by[5]["text"] == rows[4][1] and by[1]["n_replaced"] == 6
    for v in ("555-7479", "x.7@", "10.1.2.3", "2024-02-29", "4111111111111111"):
        assert v not in by[1]["text"]
    new = by[2]["text"].split()[1]
    assert by[1]["text"].count(new) == 2 and len(by[1]["text"]) - len(text) < 12


def test_pseudonyms_undo_and_formats(spark):
    """The permutation read backwards gives the value back; only ASCII digits are of a format."""

    def undo(value: int, size: int, tweak: str) -> int:
        a = next(x for x in itertools.count(2) if x * x >= size)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for r in reversed(range(pseudonyms.ROUNDS)):
                if r % 2:
                    right = (right - pseudonyms._round(KEY, tweak, size, r, left)) % b
                else:
                    left = (left - pseudonyms._round(KEY, tweak, size, r, right)) % a
            value = left * b + right
            if value < size:
                return value

    for size in (7, 10**6, 10**15 + 37):
        for value in (0, 1, size // 3, size - 1):
            assert undo(pseudonyms.permute(value, size, KEY, "t"), size, "t") == value
    long = "ab12" * 32
    texts = ["\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669", f"token {long} end", "at 2024-05-01T10:00:00Z", "2024-05-01x", "4111 1111 1111 \u0661\u0661\u0661\u0661"]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [got[i]["n_replaced"] for i in range(5)] == [0, 1, 1, 0, 0] and all(got[i]["text"] == texts[i] for i in (0, 3, 4))
    assert long not in got[1]["text"] and len(got[1]["text"]) == len(texts[1]) and got[2]["text"][-10:] == "T10:00:00Z" and "2024-05-01" not in got[2]["text"]
    other = pseudonyms.pseudonymise(spark.createDataFrame([(0, texts[1])], "doc_id long, text string"), "another").first()["text"]
    assert other != got[1]["text"]


def test_written_sequences(docs, tmp_path, spark):
    packed = packing.pack(docs, 64)
    packing.write_packed(packed, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert sorted(map(str, packing.unpack(back).collect())) == sorted(map(str, packing.unpack(packed).collect()))


def test_a_very_long_text(spark):
    """Texts beyond what a kernel takes at once: the same figures as for their parts."""
    rng = random.Random(8)
    words_ = [f"{a}{rng.randrange(10**6)}" for a in WORDS for _ in range(40)]
    body = [rng.choice(words_) for _ in range(700_000)]
    passage = body[600_000:600_100]
    rows = [(1, " ".join(body)), (2, " ".join(["start", *passage, "end"])), (3, "short text, 4111111111111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("aa"), "source": F.lit("s")})
    assert len(rows[0][1]) > 5 * ppm.CHUNK // 32
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in superkmer.dedup_windows(df).collect()}
    assert got == {1: (700_000, 0), 2: (102, 100), 3: (3, 0)}
    cut = {r["doc_id"]: r["n_removed"] for r in suffix.dedup_bytes(df).collect()}
    assert cut[1] == cut[2] >= len(" ".join(passage)) and cut[3] == 0
    near = {r["doc_id"]: r["n_shingles"] for r in minmax.near_duplicates(df).collect()}
    assert near == {1: len({tuple(body[i : i + 5]) for i in range(699_996)}), 2: 98, 3: 1}
    leaks = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contained(df, spark.createDataFrame([(5, " ".join(passage))], "item_id long, text string")).collect()}
    assert leaks == {1: (700_000, 100), 2: (102, 100), 3: (3, 0)}
    scores = {r["doc_id"]: r for r in ppm.score(df, F.lit(True)).collect()}
    assert scores[1]["n_tokens"] == 700_001 and scores[1]["score"] < scores[2]["score"] < 0
    lines = {r["doc_id"]: r["n_words"] for r in linerules.clean_lines(df).collect()}
    assert lines == {1: 700_000, 2: 102, 3: 3}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == lines
    assert {r["doc_id"]: r["n_replaced"] for r in pseudonyms.pseudonymise(df, "k").collect()}[3] == 1
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, df).collect()} == dict.fromkeys((1, 2, 3), "aa")
    encode, end = packing.encoder(packing.VOCABULARY)
    back = {r["doc_id"]: bytes(r["ids"]) for r in packing.unpack(packing.pack(df)).collect()}
    assert back == {d: encode(x) + np.array([end], np.uint16).tobytes() for d, x in rows}


@pytest.mark.parametrize("name", ["dedup", "bytes", "near", "leaks", "lines", "mix", "pack", "ppm", "pii", "lang"])
def test_empty_input(spark, name):
    df = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    run = {
        "dedup": lambda: superkmer.dedup_windows(df), "bytes": lambda: suffix.dedup_bytes(df), "near": lambda: minmax.near_duplicates(df), "leaks": lambda: decontaminate.contained(df, items),
        "lines": lambda: linerules.clean_lines(df), "mix": lambda: mixing.mix(df), "pack": lambda: packing.pack(df), "ppm": lambda: ppm.score(df, F.lit(True)), "pii": lambda: pseudonyms.pseudonymise(df, "k"), "lang": lambda: langid.identify(df, df),
    }[name]
    assert run().collect() == []


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (None, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    near = sorted(minmax.near_duplicates(df).collect(), key=str)
    assert sum(r["kept"] for r in near) == 4 and len(near) == 4
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in superkmer.dedup_windows(df).collect()) == [("3", 0), ("3", 0), ("None", 0), ("None", 80)]
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in suffix.dedup_bytes(df).collect()) == [("3", True), ("3", True), ("None", False), ("None", True)]
    assert minmax.one_of_each(df).count() == 3 and mixing.mix(df).count() == 4


def test_copies_with_and_without_an_id(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    earlier, later, copy = word("p", 60), word("q", 60), f"{word('p', 60)} {word('m', 60)} {word('q', 60)}"
    rows = [(None, copy), (5, copy), (7, copy), (3, f"{word('a', 30)} {earlier}"), (9, f"{later} {word('b', 30)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in superkmer.dedup_windows(df).collect()} == {None: 180, 5: 60, 7: 180, 3: 0, 9: 60}
