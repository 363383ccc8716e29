"""Repeated windows across a corpus, by super-k-mer buckets.

Used by substring dedup (word windows) and by suffix-array dedup (byte windows).
Consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket.  Steps, each linear in its input:

1. One scan lists the minimisers of every text (``index``).
2. A minimiser that only one text has cannot carry a repeat; the others are joined
   back, and only texts that have one go on (``flagged``).
3. Their super-k-mers are cut out once (``strings``); equal strings are pre-aggregated
   and each bucket's kernel decides its windows from the distinct strings.
4. The bucket of a minimiser that more than ``hot`` texts have is split by window: its
   windows travel as 128-bit digests, so that a passage in a third of all rows is
   counted by a partial aggregation and never meets in one task.
5. Verdicts are joined back and each text is cleaned where it stands.

Rows equal in doc_id and text are one document.  Exact copies of a text are settled
by its digest and only one of them goes through steps 3 and 4.  A document is told by
its order (doc_id) and a 64-bit hash of doc_id and text together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, mix, slices, span_hash, super_kmers, utf8, word_spans

#: Order of documents without an id: after all others.
LAST = (1 << 63) - 1
_BYTE_CODE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` tokens, minimisers of ``k`` tokens, tokens words or bytes."""

    length: int
    k: int
    words: bool
    hot: int = 2000

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return _BYTE_CODE[data], offs
        s, e, first = word_spans(data, offs)
        return span_hash(data, s, e) if len(s) else np.zeros(0, np.uint64), first

    def units(self, raw: bytes) -> bytes | list[bytes]:
        return raw.split() if self.words else raw

    def join(self, units: bytes | list[bytes]) -> bytes:
        return b" ".join(units) if self.words else units


def keyed(docs: DataFrame) -> DataFrame:
    """key (of doc_id and text), ord (doc_id, or ``LAST``), doc_id, text; a null text is empty."""
    return docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def index(keyed_docs: DataFrame, w: Windows) -> DataFrame:
    """Per text: number of tokens, digest of all of them joined, distinct minimisers, those it has twice."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = utf8(batch.column("text"))
            tokens, first = w.tokens(data, offs)
            row, _, _, h = super_kmers(tokens, first, w.length, w.k)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            same = np.zeros(len(h), bool)
            same[1:] = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
            n = batch.num_rows
            raw = data.tobytes()
            digests = [hashlib.sha256(w.join(w.units(raw[a:b]))).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]

            def lists(keep: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[keep], np.arange(n + 1)), pa.int32()), pa.array(h[keep]))

            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ord"), batch.column("doc_id"), batch.column("md5"), pa.array(np.diff(first)), pa.array(digests), lists(~same), lists(same)],
                ["key", "ord", "doc_id", "md5", "n_tokens", "sha", "hs", "again"],
            )

    schema = "key long, ord long, doc_id long, md5 binary, n_tokens long, sha string, hs array<long>, again array<long>"
    return keyed_docs.select("key", "ord", "doc_id", F.unhex(F.md5("text")).alias("md5"), "text").mapInArrow(kernel, schema)


def flagged(listed: DataFrame, w: Windows) -> DataFrame:
    """ord, key, hs, hot: minimisers that another text, or this one again, has; of the first copy of each text."""
    one = listed.filter("n = 1 OR (first_ord = ord AND first_key = key)")
    rows = one.select("ord", "key", "again", F.explode("hs").alias("h")).select("ord", "key", "h", F.array_contains("again", F.col("h")).alias("twice"))
    which = F.struct("ord", "key")
    counts = rows.groupBy("h").agg(F.min(which).alias("a"), F.max(which).alias("b"), F.max("twice").alias("twice"), F.count("*").alias("n"))
    counts = cut(counts.filter("a < b OR twice").select("h", "n"), "minimisers")
    met = joined(rows.select("ord", "key", "h"), counts.select("h", (F.col("n") > w.hot).alias("hot")), ["h"], counts, "key")
    return met.groupBy("ord", "key").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))


def strings(texts: DataFrame, w: Windows) -> DataFrame:
    """The packed super-k-mers of flagged minimisers; those of hot ones as digests of single windows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ord", "h", "hot", "start", "packed"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        out: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)
            out, held = [[] for _ in names], 0
            return made

        for batch in slices(batches):
            data, offs = utf8(batch.column("text"))
            tokens, first = w.tokens(data, offs)
            row, start, count, h = super_kmers(tokens, first, w.length, w.k)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            keys, ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            raw = data.tobytes()
            for i in range(batch.num_rows):
                a, b = bounds[i], bounds[i + 1]
                wanted = np.array(batch.column("hs")[i].as_py(), np.int64)
                hot = set(batch.column("hot")[i].as_py())
                pick = a + np.flatnonzero(np.isin(h[a:b], wanted))
                units, order = w.units(raw[offs[i] : offs[i + 1]]), LAST if ids[i] is None else ids[i]
                for j in pick:
                    at, m, value = int(start[j] - first[i]), int(count[j]), int(h[j])
                    if value in hot:
                        made = [(at + x, hashlib.blake2b(w.join(units[at + x : at + x + w.length]), digest_size=16).digest(), True) for x in range(m)]
                    else:
                        made = [(at, w.join(units[at : at + m + w.length - 1]), False)]
                    for begin, packed, is_hot in made:
                        for column, v in zip(out, (keys[i], order, value, is_hot, begin, packed), strict=True):
                            column.append(v)
                        held += len(packed) + 40
                if held > 4 << 20:
                    yield flush()
        if out[0]:
            yield flush()

    return texts.select("key", "doc_id", "text", "hs", "hot").mapInArrow(kernel, "key long, ord long, h long, hot boolean, start long, packed binary").withColumn("skey", F.xxhash64("packed"))


def repeats(docs: DataFrame, w: Windows, bucket: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hot_verdict: str, whole: Callable[[DataFrame], DataFrame], clean: Callable, result: str) -> DataFrame:
    """Run the steps of the module's docstring.

    ``bucket`` gets (h, packed, skey, ord, n) sorted by h, the distinct strings with their
    least document and their count, and yields (h, skey, verdict array<long>), a number per
    window.  ``hot_verdict`` is the same number for a digest, in SQL over ``ord`` and ``n``.
    ``whole`` adds ``gone``, whether a text goes altogether as a copy.  ``clean`` maps
    (units, ord, [(start, verdict)]) to (n_removed, n_spans, digest, kept bytes).
    """
    from_docs = keyed(docs)
    listed = cut(index(from_docs, w), "index")
    copies = listed.groupBy("md5").agg(F.count("*").alias("n"), F.min(F.struct("ord", "key")).alias("x"))
    copies = cut(copies.select("md5", "n", F.col("x.ord").alias("first_ord"), F.col("x.key").alias("first_key")), "copies")
    numbered = joined(listed, copies, ["md5"], copies, "key")
    texts = cut(from_docs.join(flagged(numbered, w), ["ord", "key"]), "texts")
    cuts = cut(strings(texts, w), "strings")
    distinct = cuts.filter("NOT hot").groupBy("h", "packed").agg(F.min("skey").alias("skey"), F.min("ord").alias("ord"), F.count("*").alias("n"))
    by_bucket = distinct.repartition("h").sortWithinPartitions("h")
    verdicts = by_bucket.mapInArrow(bucket, "h long, skey long, verdict array<long>")
    uses = cuts.groupBy("h", "skey").agg(F.count("*").alias("n"))
    hot = cuts.filter("hot").groupBy("h", "skey", "packed").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).select("h", "skey", F.array(F.expr(hot_verdict)).alias("verdict"))
    found = joined(cuts.select("ord", "key", "h", "skey", "start"), verdicts.union(hot), ["h", "skey"], uses, "key").groupBy("ord", "key").agg(F.collect_list(F.struct("start", "verdict")).alias("found"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, order, marks in zip(batch.column("text"), batch.column("ord"), batch.column("found"), strict=True):
                pairs = [(m["start"], m["verdict"]) for m in marks.as_py()]
                rows.append(clean(w.units(text.as_py().encode()), order.as_py(), pairs))
            n, spans, sha = (list(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["ord", "key", "n_removed", "n_spans", "kept"])

    cleaned = texts.select("ord", "key", "text").join(found, ["ord", "key"]).mapInArrow(kernel, "ord long, key long, n_removed long, n_spans long, kept string").dropDuplicates(["ord", "key"])
    all_docs = whole(numbered.drop("hs", "again"))
    empty = hashlib.sha256(b"").hexdigest()
    return all_docs.join(cleaned, ["ord", "key"], "left").select(
        "doc_id",
        F.col("n_tokens").alias(result),
        F.when(F.col("gone"), F.col("n_tokens")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
