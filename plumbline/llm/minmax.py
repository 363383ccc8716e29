"""Near-duplicate documents by min-max hashing (operator 9).

Each permutation gives two signature values, its least and its greatest, so that half the
hash evaluations fill the same bands.  Candidates come from equal bands.  No bucket is
expanded into pairs: its members are compared with the bucket's most central member first;
only members that stay in another component then meet the rest of the bucket in blocks inside
tasks, first by their band hashes, and which emit links and never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, gram_hash, groups, hot_keys, joined, lower_ascii, mix, slices, span_hash, split_join, unused, utf8, word_spans
from .components import components

PERMUTATIONS = 192
#: A link at the threshold agrees in fewer than ``AGREE`` bands with probability ``MISS`` at most.
AGREE, MISS = 3, 1e-6
_SEEDS = mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(991))
_MUL, _XOR = (_SEEDS[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[1::2] >> np.uint64(32)).astype(np.uint32)


def band_rows(threshold: float) -> int:
    """The most values per band that keep the chance of missing a link within ``MISS``."""

    def missed(r: int) -> float:
        n, p = 2 * (PERMUTATIONS // r), threshold**r
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(AGREE))

    return max(r for r in range(1, 33) if r == 1 or missed(r) <= MISS)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row in order, and their row numbers; a slice of the rows at a time."""
    parts, done = [], 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
        g, row = _shingle_sets(batch.column("text"), words)
        parts.append((g, row + done))
        done += batch.num_rows
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([g for g, _ in parts]), np.concatenate([row for _, row in parts])


def _shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    data, offs = utf8(column)
    data = lower_ascii(data)
    s, e, first = word_spans(data, offs)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = span_hash(data, s, e)
    g = gram_hash(tokens, words)
    row = np.searchsorted(first, np.arange(len(g)), side="right") - 1
    good = np.arange(len(g)) + words <= first[row + 1]
    g, row = g[good], row[good]
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        g = np.concatenate((g, span_hash(tokens, first[few], first[few + 1])))
        row = np.concatenate((row, few))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], row[new]


def signatures(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """Per document: size and digest of its shingle set, and its band hashes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = PERMUTATIONS // rows
        for batch in slices(batches):
            g, row = shingle_sets(batch.column("text"), words)
            n = np.bincount(row, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            start = (np.cumsum(n) - n)[full]
            sums = np.zeros((2, batch.num_rows), np.uint64)
            made = np.zeros((len(full), 2 * bands), np.uint64)
            if len(full):
                for i in (0, 1):
                    sums[i, full] = np.add.reduceat(mix(g ^ _SEEDS[i]), start)
                x = (g >> np.uint64(32)).astype(np.uint32)
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        for p in range(b * rows, (b + 1) * rows):
                            v = (x ^ _XOR[p]) * _MUL[p]
                            v ^= v >> np.uint32(16)
                            made[:, 2 * b] = mix(made[:, 2 * b] ^ np.minimum.reduceat(v, start))
                            made[:, 2 * b + 1] = mix(made[:, 2 * b + 1] ^ np.maximum.reduceat(v, start))
                made = mix(made ^ mix(np.arange(2 * bands, dtype=np.uint64)))
            offsets = np.concatenate(([0], np.cumsum((n > 0) * 2 * bands)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def star_links(pairs: DataFrame, texts: DataFrame, words: int, percent: int, most: int = 500) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough; a centre ``a`` is salted beyond ``most`` members."""
    salts = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", (F.lit(1) + F.floor(F.col("n") / most)).cast("int").alias("salts")), "stars")
    hot = salts.filter("salts > 1")  # no more than a row in ``most``
    hot = F.broadcast(hot) if hot.count() <= 1_000_000 else hot
    members = pairs.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.col("b").alias("doc_id"))
    centres = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    rows = members.withColumn("role", F.lit(1)).union(centres.withColumn("role", F.lit(0))).join(texts, "doc_id")
    rows = rows.select("a", "salt", "role", "doc_id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["a", "salt"], rows=200):
            a, salt, role, ids = (t.column(c).to_numpy() for c in ("a", "salt", "role", "doc_id"))
            g, row = shingle_sets(t.column("text").combine_chunks(), words)
            n = np.bincount(row, minlength=len(a))
            star = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])))) - 1
            own = mix(g ^ mix(star[row].astype(np.uint64)))  # a shingle within its star
            centre = role[row] == 0
            both = np.isin(own[~centre], own[centre])
            inter = np.bincount(row[~centre][both], minlength=len(a))
            size = np.zeros(star[-1] + 1, np.int64)
            np.maximum.at(size, star[role == 0], n[role == 0])
            good = (role == 1) & _linked(inter, n, size[star], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(ids[good])], ["a", "b"])

    return rows.mapInArrow(kernel, "a long, b long")


def rest_links(rest: DataFrame, signed: DataFrame, texts: DataFrame, words: int, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) between components that still share a bucket.

    ``rest`` has bucket, doc_id, component and odd: whether the document is outside its
    bucket's largest component.  Odd members, in blocks of ``block``, meet all members, in
    blocks.  First their band hashes and set sizes do: a document goes on with its text only
    where one of the other block's, of another component, agrees with it in ``AGREE`` bands or
    more and in size.  A task then compares the full sets of two blocks and emits links that
    join two components, fewer than it has documents, and never pairs.
    """
    size = cut(rest.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("odd").alias("m")), "sizes")
    blocks = size.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("m") / block).cast("int").alias("mb"))
    placed = joined(rest, blocks, ["bucket"], size, "doc_id").withColumns({"x": F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"), "y": F.pmod(F.xxhash64("doc_id"), F.col("mb")).cast("int")})
    everyone = placed.select("bucket", "doc_id", "component", "odd", F.col("x").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), F.lit(0).alias("role"))
    odd = placed.filter("odd").select("bucket", "doc_id", "component", "odd", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.col("y").alias("j"), F.lit(1).alias("role"))
    both = everyone.union(odd)
    rows = both.join(signed.select("doc_id", "n_shingles", "bands"), "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "i", "j"], rows=200):
            keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            ids, comp, role, n = (t.column(c).to_numpy() for c in ("doc_id", "component", "role", "n_shingles"))
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            new = np.ones(len(ids), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = [*np.flatnonzero(new).tolist(), len(ids)]
            good = np.zeros(len(ids), bool)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                p, q = lo + np.flatnonzero(role[lo:hi] == 1), lo + np.flatnonzero(role[lo:hi] == 0)
                if not len(p) or not len(q):
                    continue
                agree = np.zeros((len(p), len(q)), np.int16)
                for k in range(bands.shape[1]):
                    agree += bands[p, k][:, None] == bands[q, k][None, :]
                small, large = np.minimum(n[p][:, None], n[q][None, :]), np.maximum(n[p][:, None], n[q][None, :])
                may = (agree >= AGREE) & (100 * small >= percent * large) & (comp[p][:, None] != comp[q][None, :])
                good[p], good[q] = may.any(axis=1), may.any(axis=0)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[good]) for k in keys), pa.array(ids[good]), pa.array(comp[good]), pa.array(role[good])], ["bucket", "i", "j", "doc_id", "component", "role"])

    marked = cut(rows.mapInArrow(marks, "bucket long, i int, j int, doc_id long, component long, role int").distinct(), "marked")
    rows = marked.join(texts, "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "i", "j"]):
            ids, comp, role = (t.column(c).to_numpy() for c in ("doc_id", "component", "role"))
            if not (role == 1).any():
                continue
            g, row = shingle_sets(t.column("text").combine_chunks(), words)
            n = np.bincount(row, minlength=len(ids))
            order = np.argsort(g, kind="stable")
            g, row = g[order], row[order]
            lo, hi = np.searchsorted(g, g, "left"), np.searchsorted(g, g, "right")
            joined: dict[int, int] = {}

            def top(c: int, joined: dict[int, int] = joined) -> int:
                while c in joined:
                    c = joined[c]
                return c

            a, b = [], []
            place = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[place], np.arange(len(ids) + 1))
            for i in np.flatnonzero(role == 1):
                mine = place[bounds[i] : bounds[i + 1]]
                spans = hi[mine] - lo[mine]
                at = np.repeat(lo[mine], spans) + np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
                inter = np.bincount(row[at], minlength=len(ids))
                for j in np.flatnonzero(_linked(inter, n, n[i], percent) & (comp != comp[i]) & (role == 0)):
                    p, q = top(int(comp[i])), top(int(comp[j]))
                    if p != q:
                        joined[max(p, q)] = min(p, q)
                        a.append(comp[i])
                        b.append(comp[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(kernel, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id =
    component_id), one row per row of ``docs``.  Shingles are ``words`` lower-cased (A-Z)
    words; a shorter text is one shingle; a text without words, or null, has none and is
    linked with nothing.  Rows that share a doc_id are one node.  Rows with a null doc_id
    are linked with nothing, have a null component and are kept.  Other columns are ignored.
    """
    percent = round(100 * threshold)
    listed = cut(signatures(docs, words, band_rows(threshold)), "signatures")
    some = listed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = cut(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "same")
    member = cut(joined(some, same.drop("n"), ["s1", "s2", "n_shingles"], same, "doc_id").select("doc_id", "first", "n_shingles", F.when(F.col("doc_id") == F.col("first"), F.col("bands")).alias("bands")), "members")

    placed = member.filter("bands IS NOT NULL").select("doc_id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("bucket", "n")
    shared = cut(shared, "shared")
    crowded = hot_keys(shared, ["bucket"])
    buckets = cut(split_join(placed, shared, ["bucket"], crowded, "doc_id").distinct(), "buckets")
    central = buckets.groupBy("doc_id").agg(F.sum("n").alias("score"))
    centre = buckets.join(central, "doc_id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("neg"))).alias("m")).select("bucket", (-F.col("m.neg")).alias("a"))
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(central.select("doc_id"), "doc_id"), "texts")

    pairs = cut(split_join(buckets, centre, ["bucket"], crowded, "doc_id").filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    links = cut(star_links(pairs, texts, words, percent), "links")
    labels = components(links)

    inside = cut(buckets.select("bucket", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "inside")
    sizes = inside.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("h2").alias("h2"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = mixed.select("bucket", F.col("m.component").alias("largest"), "n", "h", "h2")
    once = mixed.groupBy("n", "h", "h2", "largest").agg(F.min("bucket").alias("bucket"))  # buckets with the same members need one look
    looked = mixed.select("bucket", "largest").join(once.select("bucket"), "bucket", "left_semi")
    rest = split_join(inside, looked, ["bucket"], crowded, "doc_id").withColumn("odd", F.col("component") != F.col("largest"))
    more = rest_links(rest.drop("largest"), member.filter("bands IS NOT NULL"), texts, words, percent)
    merged = components(more).select(F.col("id").alias("component"), F.col("component").alias("least"))
    final = labels.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    lone = merged.select(F.col("component").alias("id"), F.col("least").alias("component")).join(labels, "id", "left_anti")

    of = member.select("doc_id", "first").distinct().join(final.union(lone), F.col("first") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component_id"))
    out = listed.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay: one of each class, and those without a doc_id.

    Of rows that share a doc_id one stays: the first by text (null first), then by the other
    columns written as JSON.  A null or empty text is a class of its own.
    """
    name = unused(docs, "turn")
    gone = near_duplicates(docs, threshold, words).filter("NOT kept").select("doc_id").distinct()
    left = docs.filter("doc_id IS NOT NULL").join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    others = F.to_json(F.struct(F.lit(0).alias(name), *(docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text"))))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text", others))
    return left.withColumn(name, first).filter(F.col(name) == 1).drop(name).union(docs.filter("doc_id IS NULL"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=0.85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
