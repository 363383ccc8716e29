"""Mixing overlapping sources to target weights by min-cost flow (operator 2).

Documents are aggregated by the set of sources they belong to (their pattern).  Words flow
from patterns, which may be repeated at a convex cost, to the quotas of their sources.  The
flow says how many words each pattern gives; within a pattern, seeded documents are taken:
all of them as often as the flow covers the pattern whole, and those below a hash threshold
once more.  The driver only sees a row per pattern and per source.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import WORD, cut, unused

#: Sizes of the problem that the driver solves; beyond these the operator raises.
MAX_SOURCES, MAX_PATTERNS = 20_000, 200_000
#: Documents expected in the hash bucket that is looked at one by one.
BUCKET_DOCUMENTS = 1_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Share the sum of ``sizes`` by weight; what exceeds ``cap`` times a size goes to the others.

    Weights go round the sources in code-point order, null last.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > cap * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int) -> list[list[int]]:
    """Min-cost flow from patterns to sources: words that pattern ``p`` gives to its i-th source.

    The n-th repetition of a pattern costs ``2 n - 1`` a word (convex), so that a quota is
    filled from patterns that are not yet repeated.  Costs are those of the arcs into the
    patterns alone and the same for all, so the flow of least cost is reached by opening one
    repetition after the other and sending all that fits, over shortest augmenting paths.
    """
    np_, ns = len(capacity), len(quota)
    source, sink, n = np_ + ns, np_ + ns + 1, np_ + ns + 2
    to: list[int] = []
    cap: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, c: int) -> int:
        for x, y, room in ((a, b, c), (b, a, 0)):
            arcs[x].append(len(to))
            to.append(y)
            cap.append(room)
        return len(to) - 2

    into = [arc(source, p, 0) for p in range(np_)]
    give = [[arc(p, np_ + s, repeats * capacity[p]) for s in member[p]] for p in range(np_)]
    for s, words in enumerate(quota):
        arc(np_ + s, sink, words)

    def levels() -> list[int]:
        far, queue = [-1] * n, [source]
        far[source] = 0
        for a in queue:
            for k in arcs[a]:
                if cap[k] > 0 and far[to[k]] < 0:
                    far[to[k]] = far[a] + 1
                    queue.append(to[k])
        return far

    for _ in range(repeats):
        for p, words in enumerate(capacity):
            cap[into[p]] += words
        while (far := levels())[sink] >= 0:
            turn, path = [0] * n, []  # a path of arcs from the source, grown and cut back
            while True:
                at = to[path[-1]] if path else source
                if at == sink:
                    room = min(cap[k] for k in path)
                    for k in path:
                        cap[k] -= room
                        cap[k ^ 1] += room
                    path = path[: next(i for i, k in enumerate(path) if not cap[k])]
                    continue
                while turn[at] < len(arcs[at]):
                    k = arcs[at][turn[at]]
                    if cap[k] > 0 and far[to[k]] == far[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(arcs[at]):
                    path.append(arcs[at][turn[at]])
                elif path:
                    path.pop()
                    turn[to[path[-1]] if path else source] += 1
                else:
                    break
    return [[cap[k ^ 1] for k in ks] for ks in give]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, by: str = "source", added: tuple[str, ...] = ADDED) -> DataFrame:
    """Decide how often each document is taken.

    ``docs`` has doc_id, text, and the column ``by``: a string, or an array of strings for
    overlapping sources.  All other columns stay; added, under the names ``added``, are size (words), source_size and target (of
    the source, or the sums over the sources), copies, and taken = copies x size, at most
    ``cap`` x size.  A null text has size 0; a null source, or an empty array, is a source
    of its own, last in order.  Equal rows get equal copies.  Same input, same seed: same
    result.  Empty input: empty result.  Columns of ``docs`` with a name of ``added`` are replaced.
    """
    spark = docs.sparkSession
    many = isinstance(docs.schema[by].dataType, ArrayType)
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(by), F.array().cast("array<string>")))) if many else F.array(F.col(by).cast("string"))
    pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    size, source_size, target, copies, taken = added
    kept = docs.select(*(c for c in docs.columns if c not in added or c in ("doc_id", "text", by)))
    at, seeded = unused(kept, "pattern"), unused(kept, "hash")
    base = kept.withColumns({
        at: F.to_json(F.struct(pattern.alias("p")), {"ignoreNullFields": "false"}),
        size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        seeded: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
    })
    sized = cut(base.select(F.col(at).alias("__pattern"), F.col(size).alias("size"), F.col(seeded).alias("__hash")), "sizes")

    table = [(r[0], r[1], r[2]) for r in sized.groupBy("__pattern").agg(F.sum("size"), F.count("*")).limit(MAX_PATTERNS + 1).collect()]
    if len(table) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    table.sort()
    members = [json.loads(p)["p"] for p, _, _ in table]
    sizes: dict[str | None, int] = {}
    for m, (_, words, _) in zip(members, table, strict=True):
        for s in m:
            sizes[s] = sizes.get(s, 0) + words
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    quota = targets(sizes, weights, cap)
    if many:  # overlapping sources count a document once
        whole, asked = sum(words for _, words, _ in table), sum(quota.values())
        quota = {s: q * whole / asked if asked else 0.0 for s, q in quota.items()}
    place = {s: i for i, s in enumerate(names)}
    flow = route([w for _, w, _ in table], [[place[s] for s in m] for m in members], [round(quota[s]) for s in names], cap)

    rows = []
    for (p, words, n), m, f in zip(table, members, flow, strict=True):
        got = sum(f)
        full = got // words if words else 0
        rows.append((p, words, n, int(full), int(got - full * words), float(sum(sizes[s] for s in m)), float(sum(quota[s] for s in m))))
    plan = spark.createDataFrame(rows, "__pattern string, words long, n long, full long, rest long, source_size double, target double")
    decided = plan.join(_thresholds(sized, plan, max([r[2] for r in rows], default=0)), "__pattern", "left")
    turns, to = unused(kept, "turns"), (F.col("source_size").cast("long").alias(source_size), F.col("target").alias(target))
    decided = cut(decided.select(F.col("__pattern").alias(at), F.struct("full", "below", "extra").alias(turns), *to), "plan")
    out = base.join(F.broadcast(decided), at, "left")  # at most MAX_PATTERNS rows
    once_more = (F.col(seeded) < F.col(turns)["below"]) | F.array_contains(F.col(turns)["extra"], F.col(seeded))
    out = out.withColumn(copies, (F.col(turns)["full"] + F.coalesce(once_more.cast("long"), F.lit(0))).cast("long"))
    return out.withColumn(taken, F.col(copies) * F.col(size)).drop(at, seeded, turns)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it; see ``mix`` for odd rows.

    A document without a word is taken as often as its source's documents are taken in full.
    """
    names = tuple(unused(docs, c) for c in ADDED)
    made = mix(docs, weights, cap, seed, added=names)
    copies = names[ADDED.index("copies")]
    return made.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(*names)


def _thresholds(sized: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Per pattern, the hash below which documents are taken once more, and the few beyond it that fill ``rest``.

    Sizes are added up by ranges of the hash first, as many as keep a range at about
    ``BUCKET_DOCUMENTS`` documents of a pattern; only the range that holds the threshold is
    put in order.  Of the ranges after it, one document of each size is offered as a filler.
    """
    bits = max(1, math.ceil(math.log2(max(1, most / BUCKET_DOCUMENTS))))
    ranged = sized.withColumn("range", F.shiftright("__hash", 64 - bits))
    sums = ranged.groupBy("__pattern", "range").agg(F.sum("size").alias("words"))
    running = W.partitionBy("__pattern").orderBy("range")
    sums = sums.withColumn("before", F.sum("words").over(running) - F.col("words")).join(plan.select("__pattern", "rest"), "__pattern")
    edge = sums.filter("rest > 0 AND before <= rest AND rest < before + words").select("__pattern", "range", "before", "rest")
    near = ranged.join(edge, ["__pattern", "range"]).groupBy("__pattern", "before", "rest", "__hash").agg(F.sum("size").alias("size")).withColumn("later", F.lit(False))
    # A row a pattern at most, so at most MAX_PATTERNS.
    after = ranged.join(F.broadcast(edge.withColumnRenamed("range", "edge")), "__pattern").filter(F.col("range") > F.col("edge"))
    after = after.groupBy("__pattern", "before", "rest", "__hash").agg(F.sum("size").alias("size")).filter("size > 0")
    near = near.unionByName(after.groupBy("__pattern", "before", "rest", "size").agg(F.min("__hash").alias("__hash")).withColumn("later", F.lit(True)))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        """Documents of one range in the order of their hash while they fit, then the largest, of later ranges too, that fill the gap.

        At last the smallest one left, if the gap is more than half of it.
        """
        fillers = rows[rows["later"]]
        rows = rows[~rows["later"]].sort_values("__hash", kind="stable").reset_index(drop=True)
        gap = int(rows["rest"].iloc[0] - rows["before"].iloc[0])
        fits = (rows["size"].cumsum() <= gap).to_numpy()
        n = int(fits.argmin()) if not fits.all() else len(rows)
        below = int(rows["__hash"].iloc[n]) if n < len(rows) else int(rows["__hash"].iloc[-1]) + 1
        gap -= int(rows["size"].iloc[:n].sum())
        left = pd.concat([rows.iloc[n:], fillers]).sort_values(["size", "__hash"], ascending=[False, True], kind="stable")
        extra = []
        for size, value in zip(left["size"], left["__hash"], strict=True):
            if 0 < size <= gap:
                extra.append(int(value))
                gap -= int(size)
        over = left[(left["size"] > gap) & ~left["__hash"].isin(extra)]
        if len(over) and 0 < int(over["size"].iloc[-1]) < 2 * gap:
            extra.append(int(over["__hash"].iloc[-1]))
        return pd.DataFrame({"__pattern": [rows["__pattern"].iloc[0]], "below": [min(below, (1 << 63) - 1)], "extra": [extra]})

    return near.groupBy("__pattern").applyInPandas(pick, "__pattern string, below long, extra array<long>")


def op2_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to source weights 5, 2, 1, repeating."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
