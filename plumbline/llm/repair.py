"""Repair of conversations: the cheapest edits that make roles alternate (operator 12).

A Viterbi search over four states (nothing yet, after a system turn, after a user's, after an
assistant's) reads a conversation's rows as a stream.  Each state's survivor is a leaf of a
tree of backpointers; nodes that no survivor reaches lose their last reference and go, and as
soon as all survivors share an ancestor, the edits up to it are final and leave the tree.  What
stays in memory is the unresolved end of each survivor, whose edits are compared whole where
costs tie.  Texts are not held at all: each survivor has the running digest of its repair.
(Where the end alone decides, as for system turns throughout, the edits stay until then.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql

BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only role that may be written after a state.
_FORCED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ROLE = {"u": "user", "a": "assistant"}


def _inserts() -> list[tuple[int, int, int, str]]:
    """(from, to, cost, roles) of insertions before a row: none, or up to the first return to a state."""
    made = []
    for begin in range(4):
        state, roles, seen = begin, "", set()
        while state not in seen:
            made.append((begin, state, INSERT * len(roles), roles))
            seen.add(state)
            roles += _FORCED[state]
            state = _NEXT[state, _FORCED[state]]
    return made


_INSERTS = _inserts()


def steps(initial: str, fault: str | None) -> list[tuple[int, int, int, str, str]]:
    """(from, to, cost, edits, roles written) over one row; ``=`` among the roles keeps the row's own."""
    out = []
    for begin, state, cost, roles in _INSERTS:
        edits = "I" * len(roles)
        out.append((begin, state, cost + DELETE, edits + "D", roles))
        if fault in ("blank", "duplicate"):
            continue
        stays = cost + (TRUNCATED if fault == "truncated" else 0)
        if (state, initial) in _NEXT:
            out.append((begin, _NEXT[state, initial], stays, edits + "K", roles + "="))
        forced = _FORCED[state]
        out.append((begin, _NEXT[state, forced], stays + REROLE, edits + "R", roles + forced))
    return out


class _Node:
    """A row's edits on a survivor's way; refs counts later nodes and survivors that lead here."""

    __slots__ = ("edits", "last", "parent", "refs")

    def __init__(self, parent: _Node | None, edits: str) -> None:
        self.parent, self.edits, self.refs, self.last = parent, edits, 0, None
        if parent is not None:
            parent.refs += 1
            parent.last = self


def _earlier(a: tuple[_Node, str], b: tuple[_Node, str]) -> bool:
    """Whether the edits of ``a`` (a node and one more row's edits) come before those of ``b``.

    Both lead over the same rows, so each is followed back to where they part.
    """
    x, y, left, right = a[0], b[0], [a[1]], [b[1]]
    while x is not y:
        left.append(x.edits)
        right.append(y.edits)
        x, y = x.parent, y.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class _Written:
    """The running digest of a survivor's lines."""

    __slots__ = ("hash", "some")

    def __init__(self, before: _Written | None = None) -> None:
        self.hash = before.hash.copy() if before else hashlib.sha256()
        self.some = before.some if before else False

    def line(self, role: str, text: bytes) -> None:
        self.hash.update(("\n" if self.some else "").encode() + role.encode() + b":" + text)
        self.some = True

    def row(self, edits: str, roles: str, role: str, text: bytes) -> None:
        for r, e in zip(roles, edits.replace("D", ""), strict=True):
            self.line(role if r == "=" else _ROLE[r], b"" if e == "I" else text)


class Repair:
    """The cheapest edits of one conversation, row by row."""

    _known: dict[tuple[str, str | None], list] = {}

    def __init__(self) -> None:
        self.root = _Node(None, "")
        self.root.refs = 1
        self.survivors: dict[int, tuple[int, _Node, _Written]] = {START: (0, self.root, _Written())}
        self.unresolved = 0
        self.audit: list[str] = []

    def _drop(self, node: _Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def add(self, role: str, text: str, fault: str | None) -> None:
        """One more row, in order."""
        key = (role[:1], fault)
        if key not in self._known:
            if len(self._known) > 1000:
                self._known.clear()
            self._known[key] = steps(*key)
        best: dict[int, tuple[int, _Node, str, str, _Written]] = {}
        for begin, end, cost, edits, roles in self._known[key]:
            if begin not in self.survivors:
                continue
            at, node, written = self.survivors[begin]
            have = best.get(end)
            if have is None or at + cost < have[0] or (at + cost == have[0] and _earlier((node, edits), have[1:3])):
                best[end] = (at + cost, node, edits, roles, written)
        self._prune(best)
        old, own = self.survivors, text.encode()
        self.survivors = {}
        for end, (cost, node, edits, roles, written) in best.items():
            made = _Node(node, edits)
            made.refs = 1
            if roles:
                written = _Written(written)
                written.row(edits, roles, role, own)
            self.survivors[end] = (cost, made, written)
        for _, node, _ in old.values():
            self._drop(node)
        self.unresolved += 1
        self._emit()

    @staticmethod
    def _prune(best: dict[int, tuple]) -> None:
        """Drop states that can't win: what may follow them may follow a cheaper one too, at a bounded extra."""
        cost = {s: b[0] for s, b in best.items()}
        after = min(cost.get(ASSISTANT, 1 << 60), cost.get(USER, 1 << 60) + INSERT)
        if SYSTEM in best and after < cost[SYSTEM]:
            del best[SYSTEM]
        if START in best and after + DELETE < cost[START]:  # a system row kept from the start is deleted instead
            del best[START]

    def _emit(self) -> None:
        alive = {id(n) for _, n, _ in self.survivors.values()}
        while self.root.refs == 1 and id(self.root) not in alive:
            # the newest child is alive unless it lost its references: then look from a survivor
            child = self.root.last
            if child is None or child.refs == 0 or child.parent is not self.root:
                child = next(iter(self.survivors.values()))[1]
                while child.parent is not self.root:
                    child = child.parent
            self.audit.append(child.edits)
            self.unresolved -= 1
            child.parent = None
            self.root = child

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and digest after the last row."""
        ends: list[tuple[int, _Node, str, str, _Written]] = []
        for state, (cost, node, written) in self.survivors.items():
            for begin, end, more, roles in _INSERTS:
                if begin == state and (end == ASSISTANT or (end == START and not roles)):
                    ends.append((cost + more, node, "I" * len(roles), roles, written))
        won = ends[0]
        for e in ends[1:]:
            if e[0] < won[0] or (e[0] == won[0] and _earlier(e[1:3], won[1:3])):
                won = e
        cost, node, edits, roles, written = won
        way = [edits]
        while node is not self.root:
            way.append(node.edits)
            node = node.parent
        written = _Written(written)
        written.row(edits, roles, "", b"")
        return cost, "".join(self.audit) + "".join(reversed(way)), written.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by a hash of their place; null role or text: one space."""
    h = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn"))).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    made = rows.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (h == 0).alias("gone"), F.when(h == 3, 2).otherwise(1).alias("times"),
    )
    return made.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with their first fault: blank, duplicate (role and text earlier in the conversation), truncated, or null.

    Partitioned by conversation alone, so that the rows need not move again.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())) > 1
    end: Column = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(F.length(F.rtrim("text", F.lit(BLANK))) == 0, "blank").when(seen, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return rows.repartition("conv_id").withColumn("fault", F.when(~F.col("gone"), fault))


_SCHEMA = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, gone).

    Rows are taken by turn (nulls first; ties by role and text).  Rows that are ``gone`` only
    keep their conversation in the result, with zeros, an empty audit and the digest of an
    empty text.  Roles are read by their first character, none is ever legal beside s, u, a;
    null conv_ids are one conversation; equal rows are duplicates.  A conversation is one
    stream, since its digest is; nothing of it is held but unresolved edits.  Other columns
    are ignored; an empty table gives no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")] + [F.coalesce("fault", F.lit("")) == "duplicate"]
    sorted_ = faults(rows.select("conv_id", "turn", "role", "text", "gone")).sortWithinPartitions(*order)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = kernel  # no conversation yet
        one, tally, turns, before = Repair(), {}, [None, None, 0], None
        out: list[tuple] = []
        types = None

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            out.append((now, gaps, *(tally.get(k, 0) for k in ("blank", "duplicate", "truncated", "illegal")), *one.finish()))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for conv, turn, role, text, gone, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                    if conv != now:
                        if now is not kernel:
                            close()
                        now, one, tally, turns, before = conv, Repair(), {}, [None, None, 0], None
                        if len(out) >= 500:
                            yield batch_of(out)
                            out = []
                    if gone:
                        continue
                    if turn is not None and turn != turns[1]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                    if fault:
                        tally[fault] = tally.get(fault, 0) + 1
                    if before is not None and before + role[:1] not in ("su", "ua", "au"):
                        tally["illegal"] = tally.get("illegal", 0) + 1
                    before = role[:1]
                    one.add(role, text, fault)
        if now is not kernel:
            close()
        if out:
            yield batch_of(out)

    return sorted_.mapInArrow(kernel, _SCHEMA.format(kind))


def op12_survivor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, counted and repaired."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    moves = ", ".join(
        f"({b}, {e}, {c}, '{edits}', '{roles}', '{i}', '{f or ''}')"
        for i in ("s", "u", "a", "-") for f in (None, "blank", "truncated") for b, e, c, edits, roles in steps(i, f)
    )
    ends = ", ".join(f"({b}, {c}, '{'I' * len(r)}', '{r}')" for b, e, c, r in _INSERTS if e == ASSISTANT or (e == START and not r))
    blank = r"[^\x20\x09-\x0D]"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("key")} % 20 AS h FROM (SELECT *, {key} AS key FROM conversations)),
x AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM x),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM o),
g AS (SELECT *, CASE WHEN r IN ('s', 'u', 'a') THEN r ELSE '-' END AS ri, CASE WHEN fault = 'duplicate' THEN 'blank' ELSE fault END AS fi FROM f),
m(b, e, c, edits, roles, ri, fi) AS (VALUES {moves}),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM g
  UNION ALL
  SELECT conv_id, n, e AS s, best.cost, best.audit, best.lines FROM (
    SELECT v.conv_id, g.n, m.e, arg_min({{'cost': v.cost + m.c, 'audit': v.audit || m.edits, 'lines': list_concat(v.lines, list_transform(range(1, length(m.roles) + 1), lambda k:
      CASE substr(m.roles, k, 1) WHEN '=' THEN g.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN k = length(m.roles) AND right(m.edits, 1) <> 'D' THEN g.text ELSE '' END))}},
      {{'cost': v.cost + m.c, 'audit': v.audit || m.edits}}) AS best
    FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.n = v.n + 1 JOIN m ON m.b = v.s AND m.ri = g.ri AND m.fi = g.fi GROUP BY ALL)),
w(b, c, edits, roles) AS (VALUES {ends}),
z AS (SELECT conv_id, arg_min({{'cost': cost + c, 'audit': audit || edits, 'text': array_to_string(list_concat(lines, list_transform(range(1, length(roles) + 1), lambda k: CASE substr(roles, k, 1) WHEN 'u' THEN 'user:' ELSE 'assistant:' END)), chr(10))}},
    {{'cost': cost + c, 'audit': audit || edits}}) AS best
  FROM v JOIN w ON w.b = v.s WHERE n = (SELECT max(n) FROM g WHERE g.conv_id IS NOT DISTINCT FROM v.conv_id) GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL = _oracle()
