"""Language-model scores by prediction by partial matching (operator 5).

A byte-context trie of order ``ORDER`` is learned from the training texts, A-Z in lower case:
counts of each symbol after each context.  A symbol is coded at the longest context that has
it.  A context of ``t`` counts and ``q`` symbols gives a symbol of ``c`` counts (2c - 1) / 2t
and the escape to the next shorter context q / 2t (method D); the symbols of longer contexts
are excluded from shorter ones.  A text's score is the sum of log10 probabilities of its bytes
and of its end.

A symbol's probability only depends on it and the ``ORDER`` symbols before it, so the trie is
never held whole: documents are dealt to chunks; the distinct grams of a chunk are counted,
added up over chunks, given their probabilities in groups that share the end of their context,
and sent back to the chunks that asked.  Groups share the last two symbols; those of more than
``GROUP`` grams are split by one more symbol, again and again, and get the counts of the shorter
contexts that they no longer hold.  Orders 0 and 1, a table of 256 x 256 counts at most, go to
all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, groups, input_bytes, lower_ascii, mix, slices, span_hash, utf8, word_spans

ORDER = 5
#: Symbols are bytes; the byte FF, which UTF-8 never has, is the end of a text.
END, SYMBOLS, BITS = 255, 256, 8
CHUNK = 24 << 20
#: Partitions that chunks are dealt to, evenly; beyond as many, one takes several in turn.
PARTITIONS = 20_000
GROUP = 200_000
#: A gram leaves the sort key so many bits for the row.
_ROW_BITS = 63 - BITS * (ORDER + 1)
#: Stands for the end of a text among the words' hashes.
_END_WORD = mix(np.array([0x656E64], np.uint64)).view(np.int64)[0]


def _mask(k: int) -> int:
    return (1 << BITS * k) - 1


def text_grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The gram (context and symbol) of each byte and, after each row's last, of its end."""
    size = np.diff(offs)
    block = offs[:-1] + np.arange(len(size)) * (ORDER + 1)
    symbols = np.full(len(data) + len(size) * (ORDER + 1), END, np.uint8)
    spans = list(zip(block.tolist(), offs[:-1].tolist(), size.tolist(), strict=True))
    for at, a, n in spans:
        symbols[at + ORDER : at + ORDER + n] = data[a : a + n]
    gram = np.zeros(len(symbols) - ORDER, np.int64)
    for i in range(ORDER + 1):
        gram <<= BITS
        gram |= symbols[i : len(gram) + i]
    return np.concatenate([gram[at : at + n + 1] for at, _, n in spans]) if spans else gram


def text_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and of each text's end, and its row."""
    s, e, first = word_spans(data, offs)
    h = span_hash(data, s, e).view(np.int64) if len(s) else np.zeros(0, np.int64)
    rows = len(offs) - 1
    return np.concatenate((h, np.full(rows, _END_WORD))), np.concatenate((np.repeat(np.arange(rows), np.diff(first)), np.arange(rows)))


Counts = tuple[np.ndarray, np.ndarray]


def _add(parts: list[Counts]) -> Counts:
    """Counts of distinct keys, in order."""
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def _in_order(parts: list[Counts]) -> Counts:
    """A chunk's look-up table; ``parts`` is emptied on the way, to hold it once."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    values = np.concatenate([v for _, v in parts])
    parts.clear()
    return keys, values[order]


def chunk_counts(dealt: DataFrame) -> DataFrame:
    """(chunk, kind, key, n): distinct grams (kind 0) and words (1) of a chunk, with their training counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[list[Counts]] = [[], []]

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                keys, n = _add(held[kind])
                for a in range(0, len(keys), 200_000):
                    k = keys[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now, np.int32)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[a : a + 200_000])], ["chunk", "kind", "key", "n"])
                held[kind] = []

        for batch in slices(batches):
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(chunk)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now is not None and now != chunk[a]:
                    yield from out()
                now = int(chunk[a])
                part = batch.slice(a, b - a)
                learned = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                for train in (1, 0):
                    pick = learned == bool(train)
                    if not pick.any():
                        continue
                    data, offs = utf8(part.filter(pa.array(pick)).column("text"))
                    data = lower_ascii(data)
                    for kind, keys in enumerate((text_grams(data, offs), text_words(data, offs)[0])):
                        keys, n = np.unique(keys, return_counts=True)
                        held[kind].append((keys, n.astype(np.int64) * train))
                for kind in (0, 1):
                    if sum(len(k) for k, _ in held[kind]) > max(1_000_000, 2 * len(held[kind][0][0])):
                        held[kind] = [_add(held[kind])]
        if now is not None:
            yield from out()

    return dealt.sortWithinPartitions("chunk").mapInArrow(kernel, "chunk int, kind int, key long, n long")


def _sums(keys: np.ndarray, n: np.ndarray) -> Counts:
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=n).astype(np.int64)


def gram_probabilities(grams: np.ndarray, counts: np.ndarray, first_order: np.ndarray, depth: np.ndarray | int = 2, shorter: dict[int, Counts] | None = None) -> np.ndarray:
    """log10 probability of each gram's symbol after its context.

    For each context of ``depth`` symbols, ``grams`` holds all grams that end in it and a symbol.
    ``shorter[k]`` has the counts of the grams of order ``k`` below a gram's depth, all that
    share its context of ``k`` symbols.  ``first_order[x, s]`` counts s after x in all training texts.
    """
    zero = first_order.sum(axis=0)
    table = {}
    for k in range(2, ORDER + 1):
        own = np.broadcast_to(depth <= k, len(grams))
        keys, c = _sums(grams[own] & _mask(k + 1), counts[own])
        if shorter and k in shorter:
            more, first = np.unique(shorter[k][0], return_index=True)
            keys, c = _add([(keys, c), (more, shorter[k][1][first])])
        table[k] = keys, c
    pair, total, kinds, left = {}, {}, {}, {}
    for k in range(ORDER, 1, -1):
        keys, c = table[k]
        place = np.searchsorted(keys, grams & _mask(k + 1))
        ctx, of = np.unique(keys >> BITS, return_inverse=True)
        n, q = np.bincount(of, weights=c).astype(np.int64), np.bincount(of, weights=c > 0).astype(np.int64)
        pair[k] = c[place]
        mine = of[place]
        total[k], kinds[k] = n[mine], q[mine]
        # What the symbols seen here have in the next shorter context.
        seen = np.flatnonzero(c > 0)
        if k > 2:
            short = table[k - 1][1][np.searchsorted(table[k - 1][0], keys[seen] & _mask(k))]
        else:
            short = first_order[keys[seen] >> BITS & _mask(1), keys[seen] & _mask(1)]
        left[k] = np.bincount(of[seen], weights=short, minlength=len(ctx)).astype(np.int64)[mine]
    x, s = grams >> BITS & _mask(1), grams & _mask(1)
    pair[1], total[1], kinds[1] = first_order[x, s], first_order.sum(axis=1)[x], (first_order > 0).sum(axis=1)[x]
    left[1] = ((first_order > 0) @ zero)[x]
    pair[0], total[0], kinds[0] = zero[s], np.full(len(s), zero.sum()), np.full(len(s), (zero > 0).sum())

    score, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    above_left, above_kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(ORDER, -1, -1):
        t, q = total[k] - above_left, kinds[k] - above_kinds
        live, every = open_ & (total[k] > 0), kinds[k] == SYMBOLS  # with all symbols seen, none escapes
        code = live & (pair[k] > 0)
        score[code] += np.log10(np.where(every, pair[k], pair[k] - 0.5)[code] / t[code])
        escape = live & ~code & (t > 0)
        score[escape] += np.log10(q[escape] / (2 * t[escape]))
        open_ &= ~code
        if k:
            above_left, above_kinds = left[k], kinds[k]
    score[open_] -= np.log10(np.maximum(SYMBOLS - kinds[0][open_], 1))
    return score


def _context(depth: int) -> Column:
    """The last ``depth`` symbols of a gram's context."""
    return F.shiftright("key", BITS).bitwiseAND(F.lit(_mask(depth)))


def _grouped(grams: DataFrame, limit: int) -> DataFrame:
    """ctx, level, depth, key, n: grams (level 0) dealt to groups by the last ``depth`` symbols of their context.

    A group of more than ``limit`` grams is split by one more symbol, while there is one, and
    each part gets the counts of the shorter contexts (level: their order).
    """
    split = grams.withColumn("depth", F.lit(2))
    for d in range(2, ORDER):
        hot = cut(split.filter(F.col("depth") == d).groupBy(_context(d).alias("hot")).agg(F.count("*").alias("grams")).filter(F.col("grams") > limit).select("hot"), "hot")
        n = hot.count()
        if not n:
            break
        small = F.broadcast(hot) if n <= 1_000_000 else hot
        split = split.join(small, (F.col("depth") == d) & (_context(d) == F.col("hot")), "left")
        split = split.withColumn("depth", F.when(F.col("hot").isNotNull(), F.lit(d + 1)).otherwise(F.col("depth"))).drop("hot")
    ctx = F.lit(0).cast("long")
    for d in range(2, ORDER + 1):  # a bit above the symbols tells depths apart
        ctx = F.when(F.col("depth") == d, _context(d).bitwiseOR(F.lit(1 << BITS * d))).otherwise(ctx)
    rows = split.select(ctx.alias("ctx"), F.lit(0).alias("level"), "depth", "key", "n")
    deep = rows.filter("depth > 2")
    at = deep.select("ctx", "depth").distinct()
    for k in range(2, ORDER):
        counts = deep.filter(F.col("depth") > k).groupBy(F.col("key").bitwiseAND(F.lit(_mask(k + 1))).alias("key")).agg(F.sum("n").alias("n"))
        mine = at.filter(F.col("depth") > k).withColumn("short", F.col("ctx").bitwiseAND(F.lit(_mask(k))))
        rows = rows.union(counts.join(mine, F.col("short") == F.shiftright("key", BITS)).select("ctx", F.lit(k), "depth", "key", "n"))
    return rows


def _probabilities(grams: DataFrame, first_order: np.ndarray, limit: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["ctx"], rows=50_000):
            level, depth, keys, n = (t.column(c).to_numpy() for c in ("level", "depth", "key", "n"))
            own = level == 0
            shorter = {k: (keys[level == k], n[level == k]) for k in range(2, ORDER) if (level == k).any()}
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(gram_probabilities(keys[own], n[own], first_order, depth[own], shorter))], ["key", "value"])

    return _grouped(grams, limit).repartition("ctx").sortWithinPartitions("ctx").mapInArrow(kernel, "key long, value double")


def _gram_scores(data: np.ndarray, offs: np.ndarray, table: Counts) -> np.ndarray:
    """Per row, the sum over its grams of their values in ``table``."""
    rows, most = len(offs) - 1, 1 << _ROW_BITS
    out = np.zeros(rows)
    for a in range(0, rows, most):
        part = offs[a : a + most + 1]
        grams = text_grams(data[part[0] : part[-1]], part - part[0])
        grams <<= _ROW_BITS
        grams |= np.repeat(np.arange(len(part) - 1), np.diff(part) + 1)
        grams.sort()  # equal grams meet, whatever their row: one look-up each
        row = grams & (most - 1)
        grams >>= _ROW_BITS
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        value = table[1][np.searchsorted(table[0], grams[first])]
        out[a : a + most] = np.bincount(row, np.repeat(value, np.diff(np.append(first, len(grams)))), len(part) - 1)
    return out


def score(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Score each document by a model of the documents for which ``train`` holds.

    Returns doc_id, held_out (``train`` is false), n_tokens (words and the end), n_known
    (those with a training count), train_tokens, base_score (unigram, add one) and score
    (log10 probability of the text's bytes, A-Z in lower case, and end), one row per row of
    ``docs``.  A null text is empty: the end alone.  Without training documents every symbol
    is equally likely.  Null doc_ids are carried; equal rows get equal scores; empty ``docs``:
    no rows; other columns are ignored but by ``train``.  Words are told apart by a 64-bit hash.
    """
    chunks = max(1, math.ceil(input_bytes(docs, "text") / chunk_bytes))
    parts = min(chunks, PARTITIONS)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    counted = cut(chunk_counts(dealt.withColumn("chunk", F.col("chunk").cast("int")).repartitionById(parts, "chunk")), "counts")
    totals = cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    grams, words = totals.filter("kind = 0").select("key", "n"), totals.filter("kind = 1").select("key", "n")

    facts = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, vocabulary = int(facts["n"] or 0), int(facts["v"])
    first_order = np.zeros((SYMBOLS, SYMBOLS), np.int64)  # at most 256 x 256 rows reach the driver
    for r in grams.groupBy(F.col("key").bitwiseAND(F.lit(_mask(2))).alias("k")).agg(F.sum("n").alias("n")).collect():
        first_order[r["k"] >> BITS, r["k"] & _mask(1)] = r["n"]

    known = _probabilities(grams, first_order, group).select(F.lit(0).alias("kind"), "key", "value").union(words.select(F.lit(1), "key", F.col("n").cast("double")))
    asked = counted.select("chunk", "kind", "key").join(known, ["kind", "key"])
    # Narrow rows, as most are look-ups: a text has its id as key and whether it is trained on as value.
    lookups = asked.select("chunk", (F.col("chunk") * F.lit(4) + F.col("kind")).alias("place"), "key", "value", F.lit(None).cast("string").alias("text"))
    texts = dealt.select("chunk", (F.col("chunk") * F.lit(4) + 2).alias("place"), F.col("doc_id").alias("key"), F.col("train").cast("double").alias("value"), "text")
    rows = lookups.union(texts).withColumn("chunk", F.col("chunk").cast("int")).repartitionById(parts, "chunk").drop("chunk").sortWithinPartitions("place")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[list[Counts]] = [[], []]
        tables: list[Counts] = []
        for whole in batches:
            place = whole.column("place").to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                chunk, kind = divmod(int(place[a]), 4)
                if now != chunk:
                    now, held, tables = chunk, [[], []], []
                part = whole.slice(a, b - a)
                if kind < 2:
                    held[kind].append((part.column("key").to_numpy(), part.column("value").to_numpy()))
                    continue
                if not tables:
                    tables = [_in_order(held.pop(0)), _in_order(held.pop(0))]
                for batch in slices(iter([part])):
                    data, offs = utf8(batch.column("text"))
                    data = lower_ascii(data)
                    m = batch.num_rows
                    w, w_row = text_words(data, offs)
                    c = tables[1][1][np.searchsorted(tables[1][0], w)]
                    unigram = np.bincount(w_row, weights=np.log10((c + 1) / (n_train + vocabulary + 1)), minlength=m)
                    held_out = batch.column("value").to_numpy() == 0
                    columns = [batch.column("key"), pa.array(held_out), pa.array(np.bincount(w_row, minlength=m)), pa.array(np.bincount(w_row[c > 0], minlength=m)), pa.array(np.full(m, n_train, np.int64)), pa.array(unigram), pa.array(_gram_scores(data, offs, tables[0]))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 7 is 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
