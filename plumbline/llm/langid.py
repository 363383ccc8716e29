"""Language identification with hyperdimensional profiles (operator 1).

Each letter has a random vector of +1 and -1, derived from its code point alone.  An n-gram's
vector is the product of its letters' vectors, each rotated by its place (binding); a text's
vector is the sum over its n-grams (bundling).  A language's prototype is the sum of the unit
vectors of its texts; a text gets the language whose prototype, less the mean of all
prototypes, has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, slices, unused

UNKNOWN = "und"
#: N-grams whose vectors are made at once, and texts that are bundled at once.
BLOCK, TEXTS = 4096, 1024


class Space:
    """Letter vectors of ``dim`` entries and the vectors of n-grams made of them."""

    def __init__(self, dim: int = 1024, n: int = 3) -> None:
        self.dim, self.n = dim, n
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        """The vector of a code point; 0 is the gap between words."""
        v = self._letters.get(code)
        if v is None:
            words = mix(mix(np.array([code], np.uint64))[0] ^ np.arange(self.dim // 64, dtype=np.uint64))
            v = (np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1)
            self._letters[code] = v
        return v

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One row per n-gram; ``codes`` has its n code points."""
        seen, place = np.unique(codes, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in seen])
        place = place.reshape(codes.shape)
        out = np.ones((len(codes), self.dim), np.int8)
        for i in range(self.n):
            out *= np.roll(table, i, axis=1)[place[:, i]]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, n-gram number, count, codes of each n-gram) of the letter n-grams of texts."""
        lower = [t.lower() for t in texts]
        # A gap before each text and n - 1 after it, so that no n-gram is of two texts.
        joined = "".join(f" {t}" + " " * (self.n - 1) for t in lower)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(lower)), [len(t) + self.n for t in lower])
        letters, place = np.unique(points, return_inverse=True)
        is_letter = np.array([chr(c).isalpha() for c in letters.tolist()], bool)
        code = np.where(is_letter, np.arange(1, len(letters) + 1), 0)[place]
        edge = np.ones(len(code), bool)
        edge[1:] = row[1:] != row[:-1]
        keep = (code > 0) | edge
        keep[1:] |= (code[1:] == 0) & (code[:-1] > 0)  # one gap between words
        code, row = code[keep].astype(np.int64), row[keep]
        size = len(letters) + 1
        m = max(0, len(code) - self.n + 1)
        gram, alike, some = np.zeros(m, np.int64), np.ones(m, bool), np.zeros(m, bool)
        for i in range(self.n):
            gram = gram * size + code[i : m + i]
            alike &= row[i : m + i] == row[:m]
            some |= code[i : m + i] > 0
        good = alike & some
        key, count = np.unique(row[:m][good] * size**self.n + gram[good], return_counts=True)
        gram_of = key % size**self.n
        which, number = np.unique(gram_of, return_inverse=True)
        real = np.concatenate(([0], letters.astype(np.int64)))
        codes = np.stack([real[which // size ** (self.n - 1 - i) % size] for i in range(self.n)], axis=1)
        return key // size**self.n, number, count, codes

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the sum of its n-grams' vectors, their number, and how many are distinct."""
        row, number, count, codes = self.counts(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        if not len(row):
            return out, np.zeros(len(texts)), np.zeros(len(texts))
        order = np.argsort(number, kind="stable")  # by n-gram, within it by row
        edges = np.searchsorted(number[order], np.arange(0, len(codes) + BLOCK, BLOCK))
        for a, lo, hi in zip(range(0, len(codes), BLOCK), edges[:-1], edges[1:], strict=False):
            mine = order[lo:hi]
            vectors = self.grams(codes[a : a + BLOCK])
            if len(mine) * 64 >= len(texts) * len(vectors):  # a product costs so much less a cell than a sum does
                table = np.zeros((len(texts), len(vectors)), np.float32)
                table[row[mine], number[mine] - a] = count[mine]
                out += table @ vectors.astype(np.float32)
                continue
            mine = mine[np.argsort(row[mine], kind="stable")]
            for b in range(0, len(mine), BLOCK):  # few n-grams a text: add up their vectors
                part = mine[b : b + BLOCK]
                first = np.flatnonzero(np.concatenate(([True], row[part][1:] != row[part][:-1])))
                out[row[part][first]] += np.add.reduceat(vectors[number[part] - a] * count[part].astype(np.float32)[:, None], first, axis=0)
        return out, np.bincount(row, count, len(texts)), np.bincount(row, minlength=len(texts)).astype(float)

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The unit vector of each text; zero for a text without letters."""
        return _unit(self.sums(texts)[0])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def prototypes(training: DataFrame, space: Space) -> DataFrame:
    """(lang, vector, n, usual): the sum of the unit vectors of a language's texts, added up by Spark.

    ``usual`` is the mean, over the texts with a letter, of the mean product of a text's
    n-grams with the unit prototype of the other texts (the own share is taken off the sum);
    0 for a language of one text.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        n: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=1 << 19, rows=TEXTS):
            made, grams, _ = space.sums(_texts(batch))
            unit, mean = _unit(made), made / np.maximum(grams, 1)[:, None]
            each = np.stack([np.ones(len(made)), grams > 0, (unit * mean).sum(axis=1)], axis=1)
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for one in set(lang):
                pick = lang == one
                total[one] = total.get(one, 0) + np.stack([unit[pick].sum(axis=0, dtype=np.float64), mean[pick].sum(axis=0, dtype=np.float64)], axis=1)
                n[one] = n.get(one, 0) + each[pick].sum(axis=0, dtype=np.float64)
        names = sorted(total)
        rows = [(one, i, float(v), float(w), *((int(n[one][0]), int(n[one][1]), float(n[one][2])) if i == 0 else (0, 0, 0.0))) for one in names for i, (v, w) in enumerate(total[one])]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "i", "v", "w", "n", "some", "own"]), preserve_index=False)

    made = training.select("text", "lang").mapInArrow(kernel, "lang string, i long, v double, w double, n long, some long, own double")
    sums = made.groupBy("lang", "i").agg(*(F.sum(c).alias(c) for c in ("v", "w", "n", "some", "own")))
    usual = F.try_divide(F.sum(F.col("v") * F.col("w")) - F.sum("own"), F.sum("some") * F.sqrt(F.sum(F.col("v") * F.col("v"))))
    return sums.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"), F.sum("n").alias("n"),
        F.when(F.sum("some") > 1, F.coalesce(usual, F.lit(0.0))).otherwise(0.0).alias("usual"),
    )


ADDED = ("lang_pred", "score", "affinity", "n_distinct")


def predict(docs: DataFrame, learned: list[tuple[str, list[float], float]], space: Space, extra: list[str], added: tuple[str, ...] = ADDED) -> DataFrame:
    """lang_pred, score, affinity and n_distinct, under the names ``added``, of each text; ``learned`` has a row per language."""
    names = [name for name, _, _ in sorted(learned)]
    usual = np.array([u for _, _, u in sorted(learned)], np.float64)
    unit = _unit(np.array([v for _, v, _ in sorted(learned)], np.float64).reshape(len(names), space.dim))
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(space.dim)
    apart = _unit(unit - mean).astype(np.float32)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in extra) + "".join(f", `{c}` {k}" for c, k in zip(added, ("string", "double", "double", "long"), strict=True))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19, rows=TEXTS):
            texts = _texts(batch)
            total, grams, distinct = space.sums(texts)
            made, affinity = _unit(total), np.zeros(len(texts))
            blank = ~made.any(axis=1)
            if names:
                cosine = _unit(made - mean.astype(np.float32)) @ apart.T
                best = cosine.argmax(axis=1)
                score = np.where(blank, 0.0, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1))
                pred = [UNKNOWN if b else names[i] for b, i in zip(blank, best, strict=True)]
                near = (total * unit[best]).sum(axis=1) / np.maximum(grams, 1)
                known = (usual[best] > 0) & ~blank
                affinity = np.where(known, near / np.where(known, usual[best], 1), np.where(blank, 0.0, 1.0))
            else:
                score, pred = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            columns = [batch.column(c) for c in extra]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64)), pa.array(affinity), pa.array(distinct.astype(np.int64))], [*extra, *added])

    return docs.select(*extra, *(["text"] if "text" not in extra else [])).mapInArrow(kernel, schema)


def identify(docs: DataFrame, training: DataFrame, dim: int = 1024, n: int = 3, keep: list[str] | None = None, added: tuple[str, ...] = ADDED) -> DataFrame:
    """Predict the language of each text of ``docs`` from the texts and langs of ``training``.

    Adds lang_pred (a learned lang; ``und`` for a null text, one without a letter, or with
    nothing learned) and score (0 to 1, from the cosine) to the columns ``keep`` (doc_id
    unless given), and the two figures that tell whether the text is of that lang at all:
    affinity, the mean product of its n-grams with the lang's prototype, against the usual
    one of the lang's own texts (about 1 for such texts of any length, about 0 for gibberish;
    1 where a lang was learned from one text), and n_distinct, its distinct n-grams.  ``added``
    renames them; none may be among ``keep``.  Rows of ``training`` with a null text or lang are
    ignored.  Equal cosines: the first lang by name.  Equal texts: equal results.  Empty ``docs``:
    no rows.  The driver gets a vector of ``dim`` numbers a language.
    """
    if {c.lower() for c in added} & {c.lower() for c in keep or ["doc_id"]}:
        raise ValueError("a column to keep has the name of a result")
    space = Space(dim, n)
    table = cut(prototypes(training.filter("text IS NOT NULL AND lang IS NOT NULL"), space), "prototypes")
    learned = [(r["lang"], r["vector"], r["usual"]) for r in table.select("lang", "vector", "usual").collect()]  # dim numbers a language
    return predict(docs, learned, space, keep or ["doc_id"], added)


def held_out(column: str = "doc_id", of: int = 5, remainder: int = 0) -> Column:
    """crc32 of the id as text, modulo ``of``, is ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % of == remainder, F.lit(False))


def identified(docs: DataFrame, least: float = 0.5, dim: int = 1024, n: int = 3) -> DataFrame:
    """The rows of ``docs``, its own columns, whose language is known with enough affinity.

    Enough is ``least`` for a text of many distinct n-grams and less for one of few, whose
    mean scatters with the root of their number: ``least * (1 - 4 / sqrt(n_distinct))``.  At 16 or
    fewer that is 0 or less, and nearly all that has a letter stays.  The languages are
    learned from the rows that are not held out.  A null text, one without a letter, and any
    text where nothing is learned go; equal texts go or stay together; other columns, whatever
    their names, are carried as they are.
    """
    columns = docs.columns
    names = tuple(unused(docs, c) for c in ADDED)
    found = identify(docs, docs.filter(~held_out()), dim, n, keep=columns, added=names)
    lang, _, affinity, distinct = map(F.col, names)
    return found.filter((lang != UNKNOWN) & (affinity >= least * (1 - 4 / F.sqrt(distinct)))).drop(*names)


def op1_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
