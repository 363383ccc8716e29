"""Token-id matrices packed best-fit decreasing (operator 4).

Documents are dealt to shards by a hash; each shard is read as a stream, its texts are turned
into ids, and its pieces are packed into sequences of a fixed length.  The bin for a piece is
the fullest one it fits: a segment tree over capacities finds the least that is large enough.
Overlong documents are cut into pieces; nothing is dropped.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-split of the byte-level vocabulary (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_BYTES = 24 << 20
#: Partitions that shards are dealt to, evenly; beyond as many, one takes several in turn.
PARTITIONS = 20_000
_CACHED: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> tuple[Callable[[str], bytes], int]:
    """A function from text to ids (uint16 bytes) and the id that ends a document."""
    if path not in _CACHED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if len(ranks) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        plain = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes:
            return plain.encode_to_numpy(text).astype(np.uint16).tobytes()

        _CACHED[path] = encode
        _CACHED[path + "#end"] = len(ranks)
    return _CACHED[path], _CACHED[path + "#end"]


class Capacities:
    """Open bins by room left; the least room that is enough, by a segment tree over rooms."""

    def __init__(self, length: int) -> None:
        self.size = 1 << max(1, length).bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin with room for ``need``, removed from the tree."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # up to the first right sibling with a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The bin of each piece (all at most ``length``), longest first, and the number of bins."""
    out = np.zeros(len(sizes), np.int64)
    open_, n = Capacities(length), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_.take(size)
        if found is None:
            room, number = length, n
            n += 1
        else:
            room, number = found
        out[i] = number
        if room > size:
            open_.add(room - size, number)
    return out, n


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed sequences of ``length`` ids, one row each.

    Returns shard, seq, n_tokens, ids (little-endian uint16 matrix row, padded with the end
    id), positions (uint16, from 0 at each segment's start, 0 in the padding), cu_seqlens
    (cumulative segment lengths from 0), and per segment doc_ids, copies (number among rows
    equal in doc_id and text), pieces and whether it is the document's last piece (lasts).
    Each document's ids end with the end id; a null text has the end id alone.  Null doc_ids
    are carried.  Equal rows are packed as often as they occur.  Empty input: no rows.  Other
    columns are ignored.  ``vocabulary`` is a file that all executors can read.
    """
    if not 2 <= length <= 1 << 16:
        raise ValueError("length is from 2 to 65536")
    shards = max(1, math.ceil(input_bytes(docs, "text") / shard_bytes))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    rows = base.repartitionById(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard", "doc_id", "key")

    names = ["shard", "seq", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "copies", "pieces", "lasts"]
    schema = "shard int, seq int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, copies array<int>, pieces array<int>, lasts array<boolean>"
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]

    def packed(shard: int, held: list[tuple[int | None, int, np.ndarray]], end: int) -> Iterator[pa.RecordBatch]:
        pieces = []  # (document, piece, from, to)
        for d, (_, _, ids) in enumerate(held):
            pieces += [(d, p, a, min(a + length, len(ids))) for p, a in enumerate(range(0, len(ids), length))]
        sizes = np.array([to - a for _, _, a, to in pieces], np.int64)
        which, n = best_fit(sizes, length)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(n + 1))
        for first in range(0, n, 500):
            out: list[list] = [[] for _ in names]
            for b in range(first, min(n, first + 500)):
                ids, positions = np.full(length, end, "<u2"), np.zeros(length, "<u2")
                cu, at = [0], 0
                mine = [pieces[i] for i in order[bounds[b] : bounds[b + 1]]]
                for d, _, a, to in mine:
                    ids[at : at + to - a] = held[d][2][a:to]
                    positions[at : at + to - a] = np.arange(to - a)
                    at += to - a
                    cu.append(at)
                row = (shard, b, at, ids.tobytes(), positions.tobytes(), cu, [held[d][0] for d, *_ in mine], [held[d][1] for d, *_ in mine], [p for _, p, _, _ in mine], [to == len(held[d][2]) for d, _, _, to in mine])
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary)
        tail = np.array([end], np.uint16).tobytes()
        held: list[tuple[int | None, int, np.ndarray]] = []
        now, last, copy = None, None, 0
        for batch in slices(batches):
            for shard, doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "key", "text")), strict=True):
                if shard != now and held:
                    yield from packed(now, held, end)
                    held = []
                copy = copy + 1 if (shard, doc_id, key) == last else 0
                now, last = shard, (shard, doc_id, key)
                held.append((doc_id, copy, np.frombuffer(encode(text) + tail, np.uint16)))
        if held:
            yield from packed(now, held, end)

    return rows.mapInArrow(kernel, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, copy and the ids of each document, end id included: the way back."""
    segments = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "copies", "pieces")).alias("i", "s"))
    begin, end = F.element_at("cu_seqlens", F.col("i") + 1), F.element_at("cu_seqlens", F.col("i") + 2)
    cutout = segments.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.copies").alias("copy"), F.col("s.pieces").alias("piece"), F.hex(F.substring("ids", 2 * begin + 1, 2 * (end - begin))).alias("ids"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]), "")
    return cutout.groupBy("doc_id", "copy").agg(F.unhex(joined).alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet, a row each; ids and positions are fixed-size binary rows."""
    packed.write.parquet(path)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
