"""Helpers shared by the corpus operators: shared-folder tables and vectorised text arrays.

The NumPy helpers work on the UTF-8 buffer of an Arrow string column, so that no
Python object is made per word.  Words are runs of bytes outside ``20 09-0D``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once by a NumPy kernel; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

#: Windows of which the minimisers are looked for at once.
_STRETCH = 1 << 19
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own only where none is set and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither repeat nor lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, keys: list[str], most: int = 1000) -> DataFrame | None:
    """Of ``counts`` (keys, n) the keys with more than ``most`` rows, and into how many parts each is split; None if there are none.

    A key is hot beyond ``most``, or beyond the total over 500,000, so that the list is small.
    """
    rows = counts.agg(F.sum("n")).first()[0] or 0
    most = max(most, rows // 500_000)
    hot = cut(counts.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("hot_parts")), "hot")
    return None if hot.isEmpty() else hot


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, by: str) -> DataFrame:
    """Inner equi-join in which a hot key's rows of ``left`` are split by the hash of the column ``by``, and those of ``right`` repeated for each part."""
    if hot is None:
        return left.join(right, keys)
    both = left.join(right, keys)
    parts, salt = unused(both, "parts"), unused(both, "salt")
    hot = hot.withColumnRenamed("hot_parts", parts)
    one = F.coalesce(F.col(parts), F.lit(1))
    split = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(by), one).cast("int")).drop(parts)
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1))).drop(parts)
    return split.join(repeated, [*keys, salt]).drop(salt)


def joined(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """Inner equi-join in which no key brings more than about ``most`` rows of ``left`` to a task.

    ``counts`` has ``keys`` and n, the rows of ``left``.
    """
    return split_join(left, right, keys, hot_keys(counts, keys, most), by)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def key_of(docs: DataFrame) -> Column:
    """Tells rows apart by doc_id and the digest of the text; never null."""
    return F.concat_ws(":", F.md5(F.coalesce(docs["text"], F.lit(""))), docs["doc_id"].cast("string"))


def input_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a text column (one scan, one row to the driver)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string."""
    bit = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})))"


# ---------------------------------------------------------------- Arrow plumbing


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and the row offsets into them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` and at most ``rows`` rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Whole key groups from batches that come sorted by ``keys``, as few at once as make ``rows`` rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held)
        at = 0
        for to in _starts(table, keys).tolist():
            if to - at >= rows:
                yield table.slice(at, to - at)
                at = to
        held = [table.slice(at)]
    if held:
        table = pa.concat_tables(held)
        at = 0
        for to in [*_starts(table, keys).tolist(), table.num_rows]:
            if to - at >= rows or to == table.num_rows:
                yield table.slice(at, to - at)
                at = to


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a new group begins, the first one left out."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table.column(k).combine_chunks()
        v = v.to_numpy(zero_copy_only=False) if pa.types.is_integer(v.type) else np.array(v.to_pylist(), dtype=object)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------- text kernels


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        inverse = pow(base, -1, 1 << 64)
        up = np.full(size, base, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        if n <= CHUNK_BYTES + 4096:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit polynomial hash of ``values[start:end]`` for many spans at once, then mixed.

    Spans are in order; of long inputs, those that start in a stretch are done together.
    """
    n = len(values)
    if n > 4 * CHUNK_BYTES and len(start) > 1:
        edges = np.searchsorted(start, np.arange(CHUNK_BYTES, n, CHUNK_BYTES))
        parts = [(a, b) for a, b in zip([0, *edges], [*edges, len(start)], strict=True) if a < b]
        if len(parts) > 1:
            return np.concatenate([span_hash(values[start[a] : end[a:b].max()], start[a:b] - start[a], end[a:b] - start[a], base) for a, b in parts])
    up, down = _powers(base, n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hash(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` token hashes."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), 1 << 19
    for a in range(0, n, step):
        at = np.arange(min(step, n - a))
        out[a : a + len(at)] = span_hash(tokens[a : a + len(at) + k - 1], at, at + k, _BASE2)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (row count + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    on = ~_SPACE[data]
    begins, ends = on.copy(), on.copy()
    begins[1:] &= ~on[:-1]
    ends[:-1] &= ~on[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = on[edge]
    ends[edge - 1] = on[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """For each ``i``, the leftmost position of the least of ``g[i:i+w]`` (by the high 44 bits)."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, step, low = np.empty(n, np.int64), 1 << 19, np.uint64((1 << 20) - 1)
    for a in range(0, n, step):
        piece = g[a : min(n, a + step) + w - 1]
        key = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < w:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        out[a : a + len(key)] = (key & low).astype(np.int64) + a
    return out


def super_kmers(tokens: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of ``window`` tokens that share their minimiser, a ``k``-gram.

    ``first`` has the first token of each row.  Returns per run: row, first token, number of
    windows, minimiser hash (int64).
    """
    none = np.zeros(0, np.int64)
    parts = [(none, none, none, none)]
    for a in range(0, len(tokens) - window + 1, _STRETCH):  # a run ends where a stretch does
        g = gram_hash(tokens[a : a + _STRETCH + window - 1], k)
        at = sliding_min(g, window - k + 1)
        i = np.arange(a, a + len(at))
        row = np.searchsorted(first, i, side="right") - 1
        good = i + window <= first[row + 1]
        new = good.copy()
        new[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
        start = np.flatnonzero(new)
        if len(start):
            parts.append((row[start], start + a, np.add.reduceat(good.astype(np.int64), start), g[at[start]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
