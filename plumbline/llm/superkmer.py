"""Substring dedup by super-k-mer partitioning (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups
from .repeats import Windows, repeats


def window_first(strings: list[bytes], docs: list[int], length: int) -> list[list[int]]:
    """Per packed string and window, the least document that has the window's words.

    The windows of the bucket are sorted by their words; each run of equal ones is one window.
    """
    windows = []
    counts = []
    for i, s in enumerate(strings):
        ends = np.flatnonzero(np.frombuffer(s, np.uint8) == 32)
        starts = np.concatenate(([0], ends + 1))
        stops = np.concatenate((ends, [len(s)]))
        m = len(starts) - length + 1
        counts.append(m)
        windows += [(s[starts[j] : stops[j + length - 1]], docs[i], i, j) for j in range(m)]
    windows.sort()
    out = [[0] * m for m in counts]
    last, least = None, 0
    for text, doc, i, j in windows:
        if text != last:
            last, least = text, doc  # the sort puts the least document first
        out[i][j] = least
    return out


def dedup_windows(docs: DataFrame, window: int = 50, k: int = 10, hot: int = 2000) -> DataFrame:
    """Remove words covered by a window of ``window`` words that starts in a lesser doc_id too.

    Returns doc_id, n_words, n_removed, n_spans (runs removed), kept_sha256, one row per row
    of ``docs``.  Null text: no words.  Texts shorter than a window: nothing removed.  Null
    doc_id: after all others.  Rows equal in doc_id never remove each other.  Other columns
    of ``docs`` are not looked at.
    """
    w = Windows(window, k, True, hot)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["h"]):
            firsts = window_first(t.column("packed").to_pylist(), t.column("ord").to_pylist(), window)
            yield pa.RecordBatch.from_arrays([t.column("h").combine_chunks(), t.column("skey").combine_chunks(), pa.array(firsts, pa.list_(pa.int64()))], ["h", "skey", "verdict"])

    def clean(words: list[bytes], order: int, marks: list) -> tuple[int, int, str]:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, firsts in marks:
            at = start + np.flatnonzero(np.asarray(firsts) < order)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = [words[i] for i in np.flatnonzero(~gone)]
        return int(gone.sum()), spans, hashlib.sha256(b" ".join(kept)).hexdigest()

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumn("gone", (F.col("n_tokens") >= window) & (F.col("first_ord") < F.col("ord")))

    return repeats(docs, w, bucket, "ord", whole, clean, "n_words")


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents, windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN f USING (h) WHERE f.m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, array_to_string(list(word ORDER BY p), ' ') AS t
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
