"""Best-fit packing by exact complements (operator 13).

Which lengths go together depends on the counts of lengths alone, at most as many as a
sequence has tokens.  So Spark makes ids and counts lengths, the driver turns the counts into a
plan of patterns with multiplicities (a pattern makes as many sequences as its scarcest length
allows, so patterns grow with the lengths, not with the documents), and every piece finds its
sequence and offset by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .packing import PATTERN

VOCABULARY = "byte_bpe_50k.json"
END = 0
LENGTH = 2048
_CACHED: dict[str, Callable[[str], bytes]] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """Bytes to ids, where ids follow the order of merges and a plain byte-level pre-split is set, and the special strings; else None."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or told.get("normalizer") or told.get("post_processor") or model.get("dropout") or model.get("ignore_merges"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    letters, vocab, special = _byte_letters(), model["vocab"], [t["content"] for t in told.get("added_tokens", [])]
    plain = {w: i for w, i in vocab.items() if w not in special}
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if sorted(plain, key=plain.get)[-len(merged) :] != merged or len(plain) != len(merged) + 256 or len(plain) >= 1 << 31:
        return None
    return {bytes(letters[c] for c in w): i for w, i in plain.items()}, special


def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A function from text to the ids (little-endian uint32 bytes) that the tokenizers library gives.

    Where the file's ids are in the order of its merges, tiktoken's merge loop gives the same
    ids four times as fast; texts with special strings and other vocabularies go through the
    library itself.
    """
    if vocabulary not in _CACHED:
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        plain, ranked = Tokenizer.from_file(path), _ranked(path)

        def whole(text: str) -> bytes:
            return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        if ranked is None:
            _CACHED[vocabulary] = whole
            return whole
        import tiktoken

        ranks, special = ranked
        fast = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes:
            if any(x in text for x in special):
                return whole(text)
            return fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

        _CACHED[vocabulary] = encode
    return _CACHED[vocabulary]


# ---------------------------------------------------------------- the plan


class Complements:
    """Available lengths and their counts, with pair and triple sums looked up against them."""

    def __init__(self, counts: dict[int, int], length: int, largest: bool = True) -> None:
        self.left = np.zeros(length + 1, np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.order = -1 if largest else 1

    def take(self, sizes: tuple[int, ...], n: int) -> None:
        for s in sizes:
            self.left[s] -= n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """Two lengths that make ``gap``, the greater at most ``most``; the widest apart first, or the nearest."""
        high = min(gap - 1, gap if most is None else most)
        big = np.arange(-(-gap // 2), high + 1)
        if not len(big):
            return None
        small = gap - big
        good = np.flatnonzero((self.left[big] > 0) & (self.left[small] > 0) & ((big != small) | (self.left[big] > 1)))
        if not len(good):
            return None
        b = int(big[good[self.order]] if self.order < 0 else big[good[0]])
        return b, gap - b

    def triple(self, gap: int) -> tuple[int, ...] | None:
        sizes = np.flatnonzero(self.left[: max(0, gap - 1)] > 0)
        for big in sizes[:: self.order if self.order < 0 else 1].tolist():
            if 3 * big < gap or big > gap - 2:
                continue
            self.left[big] -= 1
            rest = self.pair(gap - big, big)
            self.left[big] += 1
            if rest:
                return big, *rest
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how many sequences each has; the fewer of two orders of choice.

    The longest piece left opens a sequence.  Its gap is closed by one, two or three lengths
    that sum to it exactly; where none do, the longest piece that fits goes in and the gap left
    is tried again.
    """
    return min((_planned(counts, length, largest) for largest in (True, False)), key=lambda p: sum(n for _, n in p))


def _planned(counts: dict[int, int], length: int, largest: bool) -> list[tuple[tuple[int, ...], int]]:
    index, made = Complements(counts, length, largest), []
    fits = length
    while True:
        while fits and not index.left[fits]:
            fits -= 1
        if not fits:
            return made
        pattern, gap = [fits], length - fits
        index.left[fits] -= 1
        while gap:
            found = index.exact(gap)
            if not found:
                smaller = np.flatnonzero(index.left[1 : gap + 1] > 0)
                if not len(smaller):
                    break
                found = (int(smaller[-1]) + 1,)
            index.take(found, 1)
            pattern += found
            gap -= sum(found)
        used = Counter(pattern)
        more = min(int(index.left[s]) // k for s, k in used.items())
        for s, k in used.items():
            index.left[s] -= k * more
        made.append((tuple(pattern), more + 1))


def slots(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranks of pieces by length: the first rank of each run, as length << 44 | rank, and its first sequence, offset and step.

    A run gives one slot of a pattern: rank r of the run is in sequence first + r.
    """
    rank: Counter[int] = Counter()
    key, first, offset, sequence = [], [], [], 0
    for pattern, n in patterns:
        at = 0
        for size in pattern:
            key.append(size << 44 | rank[size])
            first.append(sequence)
            offset.append(at)
            rank[size] += n
            at += size
        sequence += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (key, first, offset))


# ---------------------------------------------------------------- Spark


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids, with their rank among the pieces of their length in their part of the scan."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long" + (", ids binary" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()][: len(names)]
    end = np.array([END], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    to = min(n, at + ((n - at - 1) % length + 1))  # a shorter piece comes first
                    own = ids[4 * at : 4 * to]
                    for column, v in zip(out, (doc_id, piece, at, to - at, zlib.crc32(own), part, seen[to - at], own), strict=False):
                        column.append(v)
                    seen[to - at] += 1
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and its place there.

    A document's ids (a null text has none) end with id 0; one of more than ``length`` is cut,
    the first piece taking what the full ones leave.  Returns doc_id, piece, start, length,
    ids_crc32, sequence_id (from 0, each number used), offset and, with ``keep_ids``, ids
    (little-endian uint32).  Null doc_ids are carried, equal rows packed as often as they
    occur; other columns are ignored; an empty table gives no rows.  ``vocabulary`` is a name
    of the public tokenizers or a path that all executors can read.
    """
    if not 1 <= length < 1 << 18:
        raise ValueError("length is from 1 to 262143")
    made = cut(pieces(docs, length, vocabulary, keep_ids), "pieces")
    counts = cut(made.groupBy("length", "part").count(), "lengths")
    totals = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `length` rows
    keys, first, offset = slots(plan(totals, length), length)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    ranked = made.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    kept = [c for c in made.columns if c not in ("part", "local")]
    ranked = ranked.select(*kept, (F.col("before") + F.col("local")).alias("rank"))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = ", ".join(f"{c} {'int' if c == 'piece' else 'binary' if c == 'ids' else 'long'}" for c in [*kept, "sequence_id", "offset"])
    fields = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("length").to_numpy() << 44 | batch.column("rank").to_numpy()
            run = np.searchsorted(keys, key, side="right") - 1
            sequence = first[run] + key - keys[run]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset[run])], schema=fields)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (uint32, end to end), cu_seqlens and doc_ids of each packed sequence; needs ``keep_ids``."""
    row = F.struct("offset", "length", "doc_id", F.hex("ids").alias("ids"))
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    ends = F.transform("r", lambda x: (x["offset"] + x["length"]).cast("int"))
    return rows.select("sequence_id", F.unhex(F.array_join("r.ids", "")).alias("ids"), F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"), F.col("r.doc_id").alias("doc_ids"))


def op13_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
