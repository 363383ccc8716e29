"""Manifests, conversation repair and exact-complement packing against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import complement, merkle, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, n long, path string, part int"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def doc_rows(n: int) -> list[tuple]:
    rng = random.Random(n)
    rows = [(i, rng.choice(["A b", "", None, "É x Z", "long " * 50]), rng.choice(["en", None]), rng.choice([None, "", "s1", "s2", "é", "s1", "s1"]), i or None, "t", 1, "p", 2) for i in range(n)]
    return rows + [(n, "alone", None, "only", None, "t", 1, "p", 2)] + ([rows[0], (None, "x", None, "s1", 0, None, None, None, None)] if n > 3 else [])


def brute_manifest(rows: list[tuple], arity: int) -> list[tuple]:
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(said, (r[0], r[3], r[2], r[4], text))))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """The root and for each node its (before, after) by level."""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // arity * arity : i // arity * arity + arity]
                paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
            at = [i // arity for i in at]
        return nodes[0], paths

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((mine, *climb([leaf(r, r[1]) for r in mine])))
    root, up = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), over in zip(trees, up, strict=True):
        for r, path in zip(mine, paths, strict=True):
            own = leaf(r, r[1])
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, low(r[1])) if struck else own
            for before, after in path + over:
                now = h(before + now + after)
            out.append((r[0], own, subroot, root, h("".join(b + a for b, a in path + over)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "arity"), [(1, 16), (90, 16), (40, 2), (40, 3), (600, 16)])
def test_manifest_is_the_brute_force_one(spark, n, arity):
    rows = doc_rows(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    low = merkle.row_digest([docs[c] for c in merkle.FIELDS[:-1]] + [merkle.lower_ascii(docs["text"])])
    made = merkle.manifest(docs, arity=arity, carry={"tampered": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low)})
    shown = F.coalesce(merkle.hexed(F.col("tampered")), F.col("leaf"))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(shown, F.col("path")).alias("now"))
    got = sorted([(*r, r[5] == r[3]) for r in map(tuple, made.collect())], key=str)
    assert got == brute_manifest(rows, arity)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    made = merkle.manifest(docs)
    assert made.count() == 0 and made.columns == ["doc_id", "source", "i", "n", "leaf", "subroot", "root", "path"]


# ---------------------------------------------------------------- conversations


def brute_edits(rows: list[tuple[str, str, str | None]]) -> tuple[int, str, str]:
    """All edit sequences with up to two insertions in a row, the cheapest, then the least."""
    best = None
    gap = [x for k in range(3) for x in itertools.product("ua", repeat=k)]
    names = {"u": "user", "a": "assistant"}

    def walk(i, roles, lines, audit, cost):
        nonlocal best
        if best and (cost > best[0]):
            return
        for ins in gap:
            r, ls, au, c = roles + "".join(ins), lines + [names[x] + ":" for x in ins], audit + "I" * len(ins), cost + 3 * len(ins)
            if not re.fullmatch("s?(ua)*u?", r):
                continue
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", r) and (best is None or (c, au) < best[:2]):
                    best = (c, au, h("\n".join(ls)))
                continue
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            walk(i + 1, r, ls, au + "D", c + 4)
            if fault in ("blank", "duplicate"):
                continue
            walk(i + 1, r + (role[:1] or "?"), ls + [f"{role}:{text}"], au + "K", c + more)
            for x in "ua":
                walk(i + 1, r + x, ls + [f"{names[x]}:{text}"], au + "R", c + 3 + more)

    walk(0, "", [], "", 0)
    return best


def test_cheapest_edits_are_those_of_all_sequences():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}.", rng.choice([None, None, "blank", "duplicate", "truncated"])) for i in range(rng.randrange(0, 6))]
        one = repair.Repair()
        for r in rows:
            one.add(*r)
        assert one.finish() == brute_edits(rows), rows


def plain_edits(rows):
    """Viterbi with whole strings, no pruning."""
    state = {0: (0, "")}
    for role, _, fault in rows:
        new: dict = {}
        for b, e, c, edits, _ in repair.steps(role[:1], fault):
            if b in state:
                x = (state[b][0] + c, state[b][1] + edits)
                new[e] = min(new.get(e, x), x)
        state = new
    return min((state[b][0] + c, state[b][1] + "I" * len(r)) for b, e, c, r in repair._INSERTS if b in state and (e == 3 or (e == 0 and not r)))


def test_long_conversations_hold_only_what_is_unresolved():
    rng = random.Random(9)
    for kinds, n in ((["user", "assistant"], 3000), (["system"], 400), (["user"], 400), (["tool", "user", "system", "assistant"], 1500)):
        for faults in ([None], [None, "blank", "truncated", "duplicate"]):
            rows = [(kinds[i % len(kinds)] if rng.random() < 0.9 else rng.choice(kinds), "x.", rng.choice(faults)) for i in range(n)]
            one, most = repair.Repair(), 0
            for r in rows:
                one.add(*r)
                most = max(most, one.unresolved)
            assert most < 60 or len(kinds) == 1  # there the end alone decides
            assert one.finish()[:2] == plain_edits(rows)


def test_repair_of_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, fault string, gone_ int"
    rows = [(1, 0, "user", "Hi.", "f", 1), (1, 1, "assistant", "Yes.", "f", 1), (2, None, "user", "a", None, None), (2, 4, "user", " \x0b", None, None), (2, 4, "assistant", "b!", None, None)]
    rows += [(None, 3, "system", "S.", None, None), (3, 1, None, None, None, None), (4, 7, "user", "x" * 2_000_000 + ".", None, None)]
    rows += [(5, 1, "user", "Q?", None, None)] * 2 + [(5, 9, "user", "Q?", None, None), (5, 2, "assistant", "A?\n", None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("gone", F.col("conv_id") == 3)
    got = {r["conv_id"]: r for r in repair.repaired(df).collect()}
    empty = h("")
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "KK", h("user:Hi.\nassistant:Yes."))
    assert tuple(got[2])[1:7] == (0, 1, 0, 1, 0, 7) and got[2]["audit"] == "KKD" and got[2]["repaired_sha256"] == h("user:a\nassistant:b!")
    assert tuple(got[None])[1:] == (0, 0, 0, 0, 0, 4, "D", empty)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got[4])[6:8] == (3, "KI")
    assert tuple(got[5])[1:7] == (6, 0, 2, 0, 1, 8) and got[5]["audit"] == "KDKD"
    assert repair.repaired(df.limit(0)).count() == 0


def test_damage_follows_the_hash(spark):
    rows = [(i, t, "assistant", "Is it? So.") for i in range(20) for t in range(5)] + [(None, None, None, None)]
    got = Counter(map(tuple, repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want: Counter = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want[c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, k == 0] += 2 if k == 3 else 1
    assert got == want


# ---------------------------------------------------------------- packing


def fewest(sizes: list[int], length: int) -> int:
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= sizes[i]:
                put(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        put(i + 1, [*bins, length - sizes[i]])

    put(0, [])
    return best


def test_plan_uses_each_length_as_often_as_there_is_one():
    rng = random.Random(2)
    for case in range(60):
        counts = Counter(rng.randint(1, 40) if case % 2 else min(40, int(rng.expovariate(0.15)) + 1) for _ in range(rng.randrange(0, 400)))
        made, used = complement.plan(counts, 40), Counter()
        for pattern, n in made:
            assert sum(pattern) <= 40 and n > 0
            for s in pattern:
                used[s] += n
        assert used == +counts
        total = sum(n for _, n in made)
        assert total <= math.ceil(11 / 9 * max(math.ceil(sum(s * n for s, n in counts.items()) / 40), 1)) + 1 or total <= sum(n for s, n in counts.items() if s > 20) + 1
        assert len(made) <= sum(40 // s for s in range(1, 41))


def test_plan_is_near_the_least_number_of_sequences():
    rng = random.Random(4)
    more = [sum(n for _, n in complement.plan(Counter(sizes), 30)) - fewest(sizes, 30) for sizes in ([rng.randint(1, 25) for _ in range(rng.randrange(1, 11))] for _ in range(80))]
    assert max(more) <= 1 and sum(more) <= 4


def test_exact_complements_close_gaps():
    assert complement.plan({90: 5, 10: 5}, 100) == [((90, 10), 5)]
    assert complement.plan({60: 4, 25: 4, 15: 4}, 100) == [((60, 25, 15), 4)]
    assert complement.plan({50: 6, 30: 6, 11: 6, 9: 6}, 100)[0] in [((50, 50), 3), ((50, 30, 11, 9), 6)]


def test_pieces_come_back_whole(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(str(public_tokenizers.path(complement.VOCABULARY)))
    rng = random.Random(8)
    texts = [None, "", " ", "One two", "a <|endoftext|> b", "é" * 700, "word " * 1500, "x" * 30_000, "  \n two  blanks \t", "same", "same"]
    texts += ["".join(rng.choice("ab c\n 1'é漢") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    rows.append(rows[6])
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, length int, offset int").repartition(3)
    packed = complement.pack(docs, length=64, keep_ids=True).cache()
    ids = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    found: dict = {}
    for r in packed.collect():
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(own) == r["length"] <= 64 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        found.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"]))
    for r in rows:
        n = len(ids[r[0]])
        cuts = [0, *range(n % 64 or 64, n + 1, 64)]
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            assert found[r[0], p] == [(a, b - a)] * rows.count(r)
    whole = complement.sequences(packed).collect()
    total = sum(len(ids[r[0]]) for r in rows)
    assert math.ceil(total / 64) <= len(whole) <= math.ceil(total / 64) + 1
    assert sorted(r["sequence_id"] for r in whole) == list(range(len(whole)))
    for r in whole:
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] * 4 == len(r["ids"]) and len(r["cu_seqlens"]) == len(r["doc_ids"]) + 1
    assert complement.pack(docs.limit(0)).count() == 0


def test_hot_keys_are_split_and_lose_nothing(spark):
    from plumbline.llm.common import hot_keys, split_join
    from plumbline.llm.components import components

    left = spark.range(6000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().withColumn("w", F.col("k") * 2)
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert [tuple(r) for r in hot.collect()] == [(0, 4)]
    assert split_join(left, right, ["k"], hot, "id").agg(F.count("*"), F.sum("w"), F.countDistinct("id")).first()[:] == (6000, 2 * sum(range(4000, 6000)), 6000)
    star = spark.range(1, 5000).select(F.lit(7000).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).agg(F.count("*"), F.max("component")).first()[:] == (5000, 1)
