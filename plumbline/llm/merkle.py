"""Merkle manifests: a digest tree over the rows of each group, and one over the groups (operator 11).

A node is (tree, i, digest).  At each level the node in slot zero of a run of ``arity`` computes
its siblings' indices, one a slot offset (for two it is the index with its last bit flipped),
meets them by one equijoin and emits the parent with the run's digests side by side.  A run has
``arity`` nodes at most and (tree, i) is unique, so no key is hot.  Proofs come down again: a
node meets its parent alone, never a common top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, cut, unused

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:binary,after:binary>>"


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields end to end: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column tree) and i, their place within the tree from 0, and n, the tree's rows.

    One sort by range; places are counted from each partition's first row of a tree, so that
    no tree is in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    starts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    whole = Window.partitionBy("tree")
    starts = starts.withColumn("before", F.sum("m").over(whole.orderBy("part")) - F.col("m")).withColumn("n", F.sum("m").over(whole))
    return placed.join(starts, ["tree", "part"]).withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before", "m")


def climb(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """``leaves`` (tree, i, n, digest) and the levels above them, each written.

    A level has tree, i, n (nodes of the tree at that level) and digest, all but the first also
    children, the digests of the run end to end.  A tree of one node goes no higher.
    """
    levels = [cut(leaves, name)]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        nodes = levels[-1].filter("n > 1").select("tree", "i", "n", "digest")
        first = nodes.filter(F.col("i") % arity == 0)
        offsets = F.sequence(F.lit(0), F.least(F.lit(arity), F.col("n") - F.col("i")).cast("int") - 1)
        asked = first.select("tree", "n", F.col("i").alias("run"), F.explode(offsets).alias("slot")).withColumn("i", F.col("run") + F.col("slot"))
        met = asked.join(nodes.select("tree", "i", "digest"), ["tree", "i"])
        run = met.groupBy("tree", "run", "n").agg(F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("nodes"))
        children = F.unhex(F.array_join(F.transform("nodes", lambda x: F.hex(x["digest"])), ""))
        up = run.select("tree", (F.col("run") / arity).cast("long").alias("i"), F.ceil(F.col("n") / arity).alias("n"), children.alias("children"))
        levels.append(cut(up.withColumn("digest", F.unhex(F.sha2(hexed(F.col("children")).cast("binary"), 256))), name))
        most = -(-most // arity)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with what ``tops`` (tree, path, ...) has, each path led by the siblings on the way up."""
    others = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for nodes in reversed(levels):
        found = nodes.filter("n = 1").join(tops, "tree")
        if above is not None:
            up = above.select("tree", F.col("i").alias("run"), F.col("children").alias("siblings"), F.col("path").alias("rest"), *others)
            met = nodes.filter("n > 1").withColumn("run", F.floor(F.col("i") / arity)).join(up, ["tree", "run"])
            slot = F.pmod("i", F.lit(arity)).cast("int")
            before = F.substring("siblings", F.lit(1), slot * 32)
            after = F.substring("siblings", slot * 32 + 33, F.lit(32 * arity))
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            found = found.unionByName(met.withColumn("path", F.concat(step, "rest")).drop("run", "siblings", "rest"))
        above = found
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id", arity: int = 16, carry: dict[str, Column] | None = None) -> DataFrame:
    """Each row's leaf, its group's subroot, the root over all groups, and the proof between them.

    Rows of a ``tree`` value ascend by ``order`` (nulls first, rows equal in it by their
    digests), groups by that value (null first, bytewise).  Returns ``order``, ``tree``, i, n,
    leaf, subroot, root (hex), path (array of before and after, the siblings' digests on either
    side, level by level to the root) and the columns of ``carry``.  A null field is told from
    an empty one; equal rows are leaves of their own; other columns are ignored; a table
    without rows has no manifest.
    """
    if arity < 2:
        raise ValueError("arity is 2 or more")
    key = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = docs.select(key.alias("tree"), F.col(order).alias("placed_by"), row_digest([docs[c] for c in fields]).alias("digest"), *[c.alias(f"carried_{name}") for name, c in (carry or {}).items()])
    levels = climb(ranked(cut(rows, "leaves"), ["placed_by", "digest"]), arity, "level")
    subroots = levels[0].filter("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.filter("n = 1").select("tree", "digest"))
    groups = ranked(cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "subroots"), ["group"])
    upper = climb(groups, arity, "groups")
    root = upper[-1].filter("n = 1").select("tree", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = cut(descend(upper, root, arity).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    proved = descend(levels, tops, arity)
    told = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(unused(proved, tree) if tree != "tree" else "tree")
    return proved.select(F.col("placed_by").alias(order), told, "i", "n", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "path", *[F.col(f"carried_{name}").alias(name) for name in carry or {}])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda p: hexed(F.concat(p["before"], p["after"]))), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and a path lead to."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(hexed(p["before"]), d, hexed(p["after"])).cast("binary"), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and whether rows verify after every fifth one's text is lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = row_digest([docs[c] for c in FIELDS[:-1]] + [lower_ascii(docs["text"])])
    made = manifest(docs, carry={"tampered": F.when(struck, changed)})
    shown = F.coalesce(hexed(F.col("tampered")), F.col("leaf"))
    made = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(shown, F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6, upper: int = 4) -> str:
    """SQL for up to 16**levels rows a source and 16**upper sources: each level as one list a tree."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    leaf = lambda text: f"sha256(concat({', '.join(said(c) for c in FIELDS[:-1])}, {said(text)}))"

    def lists(a: str, n: int) -> str:
        up = lambda k: f"CASE WHEN len({a}{k}) > 1 THEN list_transform(range(0, len({a}{k}), 16), lambda s: sha256(array_to_string({a}{k}[s + 1:s + 16], ''))) ELSE {a}{k} END AS {a}{k + 1}"
        return ", ".join(up(k) for k in range(n))

    sql = f"""WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf,
  {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
  {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS struck FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a AS (SELECT *, {lists('a', levels)} FROM (SELECT source, list(leaf ORDER BY i) AS a0 FROM r GROUP BY source)),
s AS (SELECT *, a{levels}[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM a),
b AS (SELECT *, {lists('b', upper)} FROM (SELECT list(subroot ORDER BY j) AS b0 FROM s)),
f AS (SELECT r.doc_id, r.leaf, CASE WHEN r.struck THEN r.changed ELSE r.leaf END AS now, '' AS proof, s.subroot, b{upper}[1] AS root, r.i, s.j, s.* EXCLUDE (source, subroot, j), b.*
      FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source CROSS JOIN b)"""
    last = "f"
    for k, (a, i) in enumerate([(f"a{k}", f"(i // {16**k})") for k in range(levels)] + [(f"b{k}", f"(j // {16**k})") for k in range(upper)]):
        run, slot = f"({i} // 16 * 16)", f"({i} % 16)"
        before, after = f"array_to_string({a}[{run} + 1:{run} + {slot}], '')", f"array_to_string({a}[{run} + {slot} + 2:{run} + 16], '')"
        sql += f",\nf{k} AS (SELECT * REPLACE (CASE WHEN len({a}) > 1 THEN sha256(concat({before}, now, {after})) ELSE now END AS now, CASE WHEN len({a}) > 1 THEN concat(proof, {before}, {after}) ELSE proof END AS proof) FROM {last})"
        last = f"f{k}"
    return sql + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM {last}"


ORACLE_SQL = _oracle()
