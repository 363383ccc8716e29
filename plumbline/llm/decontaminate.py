"""Benchmark decontamination by a prefix-filtered set join (operator 10).

DataFrame functions only.  An item is cut into windows of consecutive words.  The tokens of
a window are its shingles of two words at their places (single words where part of a window
may differ), ordered by rarity over all documents.  A window can only agree with a document
if one of its rarest tokens, the prefix, does; how many are needed follows from how many
words may differ.  One pass over the documents looks up each of their tokens among the
prefixes, leaves out positions that would put the window outside the document (length and
position bounds), and verifies each candidate word by word over a stretch of the document as
long as the window, where the document's words are at hand.  No text is shuffled.

Tokens are looked up by a hash of their words in lower case, one word at a time, so that words
that are equal but for A-Z always meet; the check compares the words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, key_of, unused

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a side is broadcast: windows have about 100 bytes, hashes 8.  Beyond
#: these, windows go in blocks of as many, each a pass over the documents.
BROADCAST_WINDOWS, BROADCAST_HASHES = 500_000, 4_000_000


def raw_words_of(text: Column) -> Column:
    """Words of a text as they are; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return raw_words_of(F.translate(text, UPPER, LOWER))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows (words joined) with the items they are of: win, item, size."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0 AND item IS NOT NULL")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("w"), i, window), " "))
    return w.select("item", F.least(F.size("w"), F.lit(window)).alias("size"), F.explode(cuts).alias("win")).distinct()


def _token(words: Column, at: Column, shingle: int) -> Column:
    """Hash of the words from ``at`` on, each in lower case; past the last word that of nulls."""
    return F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(shingle)))


def _tokens(docs: DataFrame, shingle: int, *keep: str) -> DataFrame:
    """The token at each place of each text and one past its last word: ``keep``, words, n (of words), at, h."""
    rows = docs.select(*keep, raw_words_of(F.col("text")).alias("words"))
    rows = rows.select(*keep, "words", F.size("words").alias("n"))  # once a text, before the rows are made
    rows = rows.select(*keep, "words", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("at"))
    return rows.withColumn("h", _token(F.col("words"), F.col("at"), shingle))


def prefixes(docs: DataFrame, windows: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The rarest tokens of each window, one of which any match must have: h, win, size, place."""
    w = windows.select("win", "size", F.split("win", " ").alias("w"))
    places = w.select("win", "size", "w", F.explode(F.sequence(F.lit(0), F.col("size") - shingle)).alias("place"))
    tokens = cut(places.select("win", "size", "place", _token(F.col("w"), F.col("place"), shingle).alias("h")), "tokens")
    vocabulary = cut(tokens.select("h").distinct(), "vocabulary")
    seen = _tokens(docs, shingle).select("h")
    if vocabulary.count() <= BROADCAST_HASHES:
        seen = seen.join(F.broadcast(vocabulary), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    else:
        seen = seen.groupBy("h").agg(F.count("*").alias("df")).join(vocabulary, "h", "left_semi")
    ranked = tokens.join(seen, "h", "left").withColumn("rank", F.row_number().over(W.partitionBy("win").orderBy(F.coalesce("df", F.lit(0)), "place")))
    differ = F.col("size") - F.ceil(F.col("size") * F.lit(threshold))
    return ranked.filter(F.col("rank") <= differ * shingle + 1).select("h", "win", "size", "place")


def _search(docs: DataFrame, prefix: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """key, doc_id, n, start, size, win of each verified window; ``prefix`` rows without a window meet the end of a text."""
    rows = _tokens(docs, shingle, "key", "doc_id").join(F.broadcast(prefix), "h")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n"))
    ends = F.col("win").isNull() & (F.col("at") == F.col("n"))
    met = rows.filter(ends | (F.col("win").isNotNull() & inside & _agrees(F.col("words"), start, threshold)))
    return met.select("key", "doc_id", "n", start.alias("start"), "size", "win")


def _agrees(words: Column, start: Column, threshold: float) -> Column:
    """Whether the document's words from ``start`` on agree with the window ``win`` in enough places."""
    have = F.translate(F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("size")), " "), UPPER, LOWER)
    if threshold >= 1.0:
        return have == F.col("win")
    same = F.filter(F.zip_with(F.split(have, " "), F.split("win", " "), lambda a, b: a == b), lambda x: x)
    return F.size(same) >= F.ceil(F.col("size") * F.lit(threshold))


def contained(docs: DataFrame, items: DataFrame, window: int = 10, threshold: float = 1.0, with_key: bool = False) -> DataFrame:
    """Documents with stretches that agree with a window of an item in ``threshold`` of its words.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Returns doc_id, n_words, n_hit
    (words inside any such stretch), n_items, items_sha256 (of the item_ids, sorted as
    strings, comma-joined), items, contaminated (n_hit > 0), one row per row of ``docs``.
    An item shorter than the window is one window; one without words, with a null text or a
    null id is ignored; repeated items count once.  A null or empty text has no words.  Rows
    with one doc_id are told apart by their texts; equal rows get equal results.  Empty
    ``items``: nothing is hit; empty ``docs``: no rows.  Other columns are ignored.
    ``with_key`` adds ``key`` (of doc_id and the text's digest).
    """
    pairs = cut(item_windows(items, window), "windows")
    windows = cut(pairs.select("win", "size").distinct(), "distinct")
    base = docs.select(key_of(docs).alias("key"), docs["doc_id"], docs["text"])
    parts = []
    for shingle in (2, 1):
        mine = windows.filter((F.col("size") >= 2) if shingle == 2 else (F.col("size") < 2)) if threshold >= 1 else windows
        n = mine.count() if threshold >= 1 or shingle == 1 else 0
        if n:
            prefix = cut(prefixes(base, mine, threshold, shingle), "prefixes")
            blocks = -(-prefix.count() // BROADCAST_WINDOWS)
            parts += [(shingle, prefix.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b) if blocks > 1 else prefix) for b in range(blocks)]
    shingle, first = parts[0] if parts else (1, docs.sparkSession.createDataFrame([], "h long, win string, size int, place int"))
    null = F.lit(None).cast("string")
    end = docs.sparkSession.range(1).select(F.xxhash64(*[null] * shingle).alias("h"), null.alias("win"), F.lit(0).alias("size"), F.lit(0).alias("place"))
    found = [_search(base, first.union(end), threshold, shingle)] + [_search(base, prefix, threshold, s) for s, prefix in parts[1:]]
    met = cut(reduce(DataFrame.union, found), "spots")

    hits = met.filter("win IS NOT NULL")
    reach = lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)
    spots = hits.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("spots"))
    n_hit = spots.select("key", F.size(F.array_distinct(F.flatten(F.transform("spots", reach)))).cast("long").alias("n_hit"))
    small = F.broadcast(pairs) if pairs.count() <= BROADCAST_WINDOWS else pairs
    which = hits.select("key", "win").distinct().join(small.select("win", "item"), "win").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = met.filter("win IS NULL").select("key", "doc_id", F.col("n").cast("long").alias("n_words")).join(n_hit.join(which, "key"), "key", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        *(["key"] if with_key else []), "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, threshold: float = 1.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that have no stretch of an item (see ``contained``)."""
    name = unused(docs, "key")
    bad = cut(contained(docs, items, window, threshold, with_key=True).filter("contaminated").select(F.col("key").alias(name)).distinct(), "contaminated")
    small = F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS else bad
    return docs.withColumn(name, key_of(docs)).join(small, name, "left_anti").drop(name)


def op10_prefix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents, windows of 10 words."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained(docs, items).drop("items")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.c, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(words.c, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
