"""Repeated byte strings by blockwise suffix sorting with a difference cover (operator 8).

The suffixes of one bucket (those that share a minimiser) are sorted at a time.  They are
first ordered by their leading ``PERIOD`` bytes; ties are then resolved from ranks, computed
beforehand for the block, of the suffixes at positions in a difference cover: for any two
positions there is one shift below the period that takes both into the cover.  Memory is
bounded by the block, whatever the length of the ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups
from .repeats import Windows, repeats

#: A perfect difference cover: each residue mod 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
_SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of rows by ``keys``, the last the most significant."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank, among cover positions, of the suffix that starts at each (-1 elsewhere).

    ``words`` has the 8 bytes from each position on, big-endian; string ``i`` is at
    ``begin[i]:end[i]``.  Prefix doubling by multiples of the period, which keep to the cover.
    """
    at = np.arange(int(end[-1]))
    string = np.searchsorted(end, at, side="right")
    inside = np.isin(at % PERIOD, COVER) & (at >= begin[string])
    pos = np.flatnonzero(inside)
    stop = end[string[pos]]
    left = np.minimum(stop - pos, PERIOD)
    rank = np.full(len(words) + PERIOD, -1, np.int64)
    rank[pos] = _dense(left, words[pos + 8] >> np.uint64(24), words[pos])
    step = PERIOD
    while step < int((end - begin).max()):
        ahead = np.where(pos + step < stop, rank[np.minimum(pos + step, len(words) - 1)], -1)
        made = _dense(ahead, rank[pos])
        done = int(made.max()) == len(pos) - 1
        rank[pos] = made
        if done:
            break
        step *= 2
    return rank


def sort_suffixes(pos: np.ndarray, bucket: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``pos`` by bucket, then by text."""
    head, tail = words[pos], words[pos + 8] >> np.uint64(24)
    order = np.lexsort((tail, head, bucket))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (bucket[order][1:] == bucket[order][:-1]) & (head[order][1:] == head[order][:-1]) & (tail[order][1:] == tail[order][:-1])
    slots = np.flatnonzero(same[:-1] | same[1:])
    group = np.cumsum(~same[slots]) if len(slots) else np.zeros(0, np.int64)
    while len(slots):
        # Three-way partition of all tied groups at once, each about its middle suffix.
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(pos[order[slots[first + size // 2]]], size)
        mine = pos[order[slots]]
        shift = _SHIFT[mine % PERIOD, pivot % PERIOD]
        side = np.sign(rank[mine + shift] - rank[pivot + shift])
        by = np.lexsort((side, group))
        order[slots] = order[slots[by]]
        group, side = group[by], side[by]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
        alone = new & np.append(new[1:], True)
        keep = ~alone & (side != 0)
        group = np.cumsum(new)[keep]
        slots = slots[keep]
    return order


def repeated(strings: list[bytes], bucket: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string, for each of its ``length``-byte windows, how often the bucket has it (strings count ``n`` times)."""
    sizes = np.array([len(s) for s in strings])
    pad = 16
    end = np.cumsum(sizes + pad) - pad
    begin = end - sizes
    data = np.frombuffer(b"".join(s + bytes(pad) for s in strings) + bytes(8), np.uint8)
    words = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        words |= data[i : len(words) + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    rank = cover_ranks(words, begin, end)
    count = sizes - length + 1
    which = np.repeat(np.arange(len(strings)), count)
    starts = np.cumsum(count) - count
    pos = np.arange(int(count.sum())) - np.repeat(starts, count) + np.repeat(begin, count)
    order = sort_suffixes(pos, bucket[which], words, rank)
    a, b = pos[order[:-1]], pos[order[1:]]
    same = bucket[which[order[:-1]]] == bucket[which[order[1:]]]
    for at in [*range(0, length - 7, 8), length - 8]:  # neighbours that agree in all bytes of a window
        left = np.flatnonzero(same)
        same[left] = words[a[left] + at] == words[b[left] + at]
    run = np.concatenate(([0], np.cumsum(~same)))
    total = np.bincount(run, weights=n[which[order]]).astype(np.int64)
    out = np.empty(len(pos), np.int64)
    out[order] = total[run]
    return np.split(out, starts[1:])


def dedup_bytes(docs: DataFrame, length: int = 200, k: int = 40, hot: int = 2000) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, one row
    per row of ``docs``.  Null text: empty.  Texts shorter than ``length``: nothing removed.
    Null doc_ids and repeated rows count as documents of their own.  Other columns of
    ``docs`` are not looked at.  ``length`` and ``k`` are at least 16.
    """
    w = Windows(length, k, False, hot)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["h"], rows=1000):
            n, h = t.column("n").combine_chunks().to_numpy(), t.column("h").combine_chunks().to_numpy()
            found = repeated(t.column("packed").to_pylist(), h, n, length)
            yield pa.RecordBatch.from_arrays([pa.array(h), t.column("skey").combine_chunks(), pa.array([(x > 1).astype(np.int64) for x in found], pa.list_(pa.int64()))], ["h", "skey", "verdict"])

    def clean(raw: bytes, order: int, marks: list) -> tuple[int, int, str]:
        edge = np.zeros(len(raw) + 1, np.int64)
        for start, verdict in marks:
            at = start + np.flatnonzero(verdict)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumn("gone", (F.col("n_tokens") >= length) & (F.col("n") > 1))

    return repeats(docs, w, bucket, "CAST(n > 1 AS BIGINT)", whole, clean, "n_bytes")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings of all documents, 200 bytes or more."""
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
