"""Line-first quality rules (operator 6).

Each line is judged first: its closing punctuation, shouting, navigation, symbols, and
boilerplate phrases.  Lines that fail are removed; a text that loses more than a share of its
words is rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hash, mix, slices, span_hash, utf8, word_spans

BLANK = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture in English, German, French and Spanish, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "cookies policy", "enable javascript", "javascript is disabled", "lorem ipsum",
    "privacy policy", "terms of service", "terms of use", "sign in", "log in", "subscribe to our newsletter", "click here",
    "copyright ©", "powered by", "skip to content", "read more",
    "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "nutzungsbedingungen", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "cliquez ici", "conditions d'utilisation", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "haga clic aquí", "términos de uso", "aviso legal",
)
CLOSING = r"""[.!?;:"')\]…”’»]$"""


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Ratios are per word of the line; ``most_lost`` is the share of a text's words.

    A line of ``prose_words`` or more that ends a sentence within it may stop short of the last one.
    """

    min_line_words: int = 3
    separators: int = 2
    symbols_per_word: float = 0.5
    shouts_per_word: float = 0.5
    prose_words: int = 12
    most_lost: float = 0.5
    min_words: int = 50
    most_repeated: float = 0.5


_SENTENCE = re.compile(rb"[.!?] ")
_CLOSING, _BOILER = re.compile(CLOSING), re.compile("|".join(map(re.escape, BOILERPLATE)))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_fault(line: bytes, rules: Rules) -> str | None:
    """The first rule that a line with a word fails, or None."""
    line = line.strip(BLANK)
    n = len(line.split())
    if n < rules.min_line_words or line.count(b"|") + line.count(b">") + line.count("»".encode()) + line.count("•".encode()) >= rules.separators:
        return "navigation"
    if len(line) - len(line.translate(None, SYMBOLS)) > rules.symbols_per_word * n:
        return "symbols"
    closed = _CLOSING.search(line.decode("utf-8", "replace")) or (n >= rules.prose_words and _SENTENCE.search(line))
    if line.count(b"!") + line.count(b"?") > rules.shouts_per_word * n or not closed:
        return "punctuation"
    if _BOILER.search(line.translate(_LOWER).decode("utf-8", "replace")):
        return "boilerplate"
    return None


def base_measures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows = len(offs) - 1
    s, e, first = word_spans(data, offs)
    n_words = np.diff(first)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per_word = np.concatenate(([0], np.cumsum(chars[e] - chars[s])))
    word_chars = per_word[first[1:]] - per_word[first[:-1]]
    marks = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))))
    n_symbols = marks[offs[1:]] - marks[offs[:-1]]

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((breaks + 1, offs[:-1])))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offs, starts, side="right") - 1
    stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offs[line_row + 1])
    worded = np.searchsorted(s, stops) > np.searchsorted(s, starts)
    starts, stops, line_row = starts[worded], stops[worded], line_row[worded]
    h = span_hash(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    n_dup = np.bincount(line_row[_seen_before(line_row, h)], minlength=rows)

    again = np.zeros(len(s) + 1, np.int64)
    if len(s) >= 3:
        g = gram_hash(span_hash(data, s, e), 3)
        row = np.searchsorted(first, np.arange(len(g)), side="right") - 1
        good = np.flatnonzero(np.arange(len(g)) + 3 <= first[row + 1])
        key = mix(g[good] ^ mix(row[good].astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = good[count[which] > 1]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + 3, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(again)[:-1] > 0)))
    return n_words, word_chars, n_symbols, n_dup, covered[first[1:]] - covered[first[:-1]]


def _seen_before(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, row))
    out = np.zeros(len(h), bool)
    out[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return out


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008  frozen
    """Measures, cleaned text and verdict of each document, one row per row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_lines_removed, n_words_lost, faults (rule to count), kept, text (the lines that
    are left).  A null or empty text has no words: base_failed.  A line without a word is kept
    and not judged.  Null doc_ids pass through; equal rows get equal results; empty ``docs``: no
    rows; other columns are ignored.  Repeated lines and 3-word windows are told by 64-bit hashes.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_lines_removed long, n_words_lost long, faults map<string,long>, kept boolean, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = utf8(batch.column("text"))
            n_words, word_chars, n_symbols, n_dup, n_repeat = base_measures(data, offs)
            failed = (n_words < rules.min_words) | (n_repeat > rules.most_repeated * n_words)
            raw = data.tobytes()
            lines, removed, lost, faults, texts = [], [], [], [], []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                found: dict[str, int] = {}
                left, gone, total = [], 0, 0
                for line in raw[a:b].split(b"\n"):
                    if not line.strip(BLANK):
                        left.append(line)
                        continue
                    total += 1
                    fault = line_fault(line, rules)
                    if fault is None:
                        left.append(line)
                    else:
                        found[fault] = found.get(fault, 0) + 1
                        gone += len(line.split())
                lines.append(total)
                removed.append(sum(found.values()))
                lost.append(gone)
                faults.append(list(found.items()))
                texts.append(b"\n".join(left).decode("utf-8", "replace"))
            lost_a = np.array(lost, np.int64)
            kept = ~failed & (lost_a <= rules.most_lost * n_words)
            columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)), pa.array(failed), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(lost_a), pa.array(faults, pa.map_(pa.string(), pa.int64())), pa.array(kept), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents."""
    made = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_lost", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g
      JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) x ON g.doc_id = x.doc_id AND g.g = x.g) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw FROM d),
m AS (SELECT doc_id, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
        len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, raw, n, n < 3 OR len(regexp_extract_all(line, '[|>»•]')) >= 2 OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.5 * n
        OR len(regexp_extract_all(line, '[!?]')) > 0.5 * n OR NOT (regexp_matches(line, '[.!?;:"''\)\]…”’»]$') OR (n >= 12 AND regexp_matches(line, '[.!?] ')))
        OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'BOILER') AS bad FROM m),
ll AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS dup, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(ll.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.c, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.c, 0) > 50 * len(w) AS base_failed,
  CAST(coalesce(ll.lost, 0) AS BIGINT) AS n_words_lost,
  NOT (len(w) < 50 OR 100 * coalesce(r.c, 0) > 50 * len(w)) AND coalesce(ll.lost, 0) <= 0.5 * len(w) AS kept
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN ll ON ll.doc_id = d.doc_id
""".replace("BOILER", "|".join(BOILERPLATE).replace("'", "''"))
