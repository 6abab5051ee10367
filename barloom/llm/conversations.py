"""Conversation structure repair: a forward Viterbi pass over each conversation's turns.

Role initials of a repaired conversation follow the grammar (s?(ua)+)?, an automaton of four states: nothing yet, after
system, after user, after assistant. Each turn is kept, given the role that the grammar asks for, or deleted; empty
turns may be inserted anywhere. A state carries its cheapest edits as (cost, audit string); after each turn the layer
is closed by insert transitions, of which two in a row suffice, as a third would lead back at a cost. Edits of one
layer and cost are never a prefix of each other (what follows would be inserts, which cost), so the smaller audit
string stays the smaller one whatever follows: the pass finds the cheapest edits with the least audit string.

Turns are dealt by conversation and sorted by Spark; a task reads them as a stream. Of a conversation it holds the
four states' audit strings (without the part that they share) and texts of at most FOLD_BYTES for each: older ones are
in the states' SHA-256 already, so that a conversation of any length needs little memory.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts of a conversation that a state may hold before they go into its hash, in bytes and turns.
FOLD_BYTES, FOLD_TURNS = 4 << 20, 4096
RECAST, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept turn leads to, by the state before and the role's initial.
KEPT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state and role that the grammar asks for next.
NEXT = {BEGIN: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = {"su", "ua", "au"}
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that crc32("conv_id:turn") % 20 gives them: conv_id, turn, role, text, copies.

    0 drops a row (copies = 0, so that its conversation stays known), 1 empties its text, 2 takes its sentence ends
    away, 3 doubles it, 4 makes it the user's. A null role, text, identifier or turn counts as one space (in the key
    only, for identifier and turn). Rows of one identifier and turn get the same fault.
    """
    key = F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    role = F.when(fault == 4, "user").otherwise(_or_space("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


class Path:
    """The cheapest edits that lead to a state: cost, audit string, repaired role initials, and their text."""

    __slots__ = ("cost", "audit", "roles", "base", "tail")

    def __init__(self, cost, audit, roles, base, tail):
        self.cost, self.audit, self.roles, self.base, self.tail = cost, audit, roles, base, tail

    def then(self, cost: int, edit: str, role: str = "", text: str = "") -> Path:
        if not role and edit == "D":
            return Path(self.cost + cost, self.audit + edit, self.roles, self.base, self.tail)
        return Path(self.cost + cost, self.audit + edit, self.roles + (role[:1] or " "), self.base, (self.tail, role, text))

    def fold(self) -> None:
        """Move the held texts into the hash."""
        parts, tail = [], self.tail
        while tail is not None:
            tail, role, text = tail
            parts.append(f"{role}:{text}")
        if parts:
            first = self.base is None
            self.base = hashlib.sha256() if first else self.base.copy()
            self.base.update(("" if first else "\n").encode() + "\n".join(reversed(parts)).encode("utf-8", "surrogatepass"))
            self.tail = None


def _least(paths: list[Path | None], state: int, path: Path) -> None:
    held = paths[state]
    if held is None or path.cost < held.cost or (path.cost == held.cost and path.audit < held.audit):
        paths[state] = path


def _closed(paths: list[Path | None]) -> list[Path | None]:
    """The layer with inserted turns: towards the user's first, then towards the assistant's."""
    before = list(paths)
    for state in (BEGIN, SYSTEM, ASSISTANT):
        if before[state] is not None:
            _least(paths, USER, before[state].then(INSERT, "I", "user"))
    if paths[USER] is not None:
        _least(paths, ASSISTANT, paths[USER].then(INSERT, "I", "assistant"))
    # what only the first state allows, a system turn, saves no more than its deletion: dearer states win nothing
    if paths[BEGIN] is not None and paths[BEGIN].cost > paths[ASSISTANT].cost + DELETE:
        paths[BEGIN] = None
    if paths[SYSTEM] is not None and paths[SYSTEM].cost > paths[ASSISTANT].cost:
        paths[SYSTEM] = None
    return paths


class Conversation:
    """One conversation's report, turn by turn in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.distinct = 0
        self.initial: str | None = None
        self.done: list[str] = []
        self.done_roles: list[str] = []
        self.turns = self.bytes = 0
        self.paths = _closed([Path(0, "", "", None, None), None, None, None])

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        end = text.rstrip(BLANKS)[-1:]
        blank = not end
        drop = blank or seen
        cut = not drop and end not in ".!?"
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut
        extra = CUT if cut else 0
        after: list[Path | None] = [None] * 4
        for state, path in enumerate(self.paths):
            if path is None:
                continue
            _least(after, state, path.then(DELETE, "D"))
            if drop:
                continue
            if (to := KEPT.get((state, initial))) is not None:
                _least(after, to, path.then(extra, "K", role, text))
            to, wanted = NEXT[state]
            _least(after, to, path.then(RECAST + extra, "R", wanted, text))
        self.paths = _closed(after)
        self.turns, self.bytes = self.turns + 1, self.bytes + len(text)
        if self.turns >= FOLD_TURNS or self.bytes >= FOLD_BYTES:
            self._fold()

    def _fold(self) -> None:
        live = [p for p in self.paths if p is not None]
        for p in live:
            p.fold()
        for name, done in (("audit", self.done), ("roles", self.done_roles)):
            shared = os.path.commonprefix([getattr(p, name) for p in live])
            done.append(shared)
            for p in live:
                setattr(p, name, getattr(p, name)[len(shared) :])
        self.turns = self.bytes = 0

    def row(self) -> dict:
        ends = [p for p in (self.paths[BEGIN], self.paths[ASSISTANT]) if p is not None]
        best = min(ends, key=lambda p: (p.cost, p.audit))
        best.fold()
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": best.cost, "audit": "".join(self.done) + best.audit, "roles": "".join(self.done_roles) + best.roles,
            "repaired_sha256": (best.base or hashlib.sha256()).hexdigest(),
        }


_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in REPORT.split(", "))])
#: Conversations of an output batch.
BATCH = 2000


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Conversation | None = None
    out: list[dict] = []
    for batch in batches:
        for conv, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = Conversation(conv)
            for k in range(copies):
                now.add(turn, role, text, k > 0 or not first)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    if now is not None:
        out.append(now.row())
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with `first`: no earlier row of the conversation has this role and text."""
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"),
        F.coalesce(F.col("copies"), F.lit(1)).cast("int").alias("copies"),
    )
    earlier = Window.partitionBy("conv_id", "role", "text", F.col("copies") > 0).orderBy("turn")
    return rows.repartition("conv_id").withColumn("first", F.row_number().over(earlier) == 1)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, copies): the report's columns, and roles.

    A conversation's rows are taken by turn (nulls first; rows of one turn by role, then text); a row counts `copies`
    times, with 0 it only makes its conversation known. Null roles and texts count as one space, null identifiers are
    one conversation, a conversation without rows is repaired already, an empty table gives no rows; other columns are
    ignored. Texts may have any length. Repeated rows are duplicates and go. `roles` has the initial of each turn that
    the repaired conversation has.
    """
    ordered = _ordered(rows).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_run, REPORT)


def repaired_turns(rows: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), edit, turn, role, text.

    Inserted turns have an empty text and no turn number. The audit string of each conversation is laid beside its
    rows, by the number of the row that an edit takes.
    """
    report = repaired(rows) if report is None else report
    each = rows.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = each.select(F.col("conv_id").alias("c"), "turn", "role", "text", F.row_number().over(order).alias("n"))
    edits = report.select("conv_id", "roles", F.posexplode(F.split("audit", "(?!^)")).alias("at", "edit")).where("edit != ''")
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.select("conv_id", "edit", "roles", F.sum(F.expr("int(edit != 'I')")).over(upto).alias("row"), (F.sum(F.expr("int(edit != 'D')")).over(upto) - 1).alias("position"))
    edits = edits.where("edit != 'D'")
    both = edits.join(numbered, edits["conv_id"].eqNullSafe(numbered["c"]) & (F.col("row") == F.col("n")) & (F.col("edit") != "I"), "left")
    given = F.when(F.substring("roles", F.col("position").cast("int") + 1, F.lit(1)) == "u", "user").otherwise("assistant")
    return both.select("conv_id", "position", "edit", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations, after the damage that `damaged` does: see `repaired`."""
    return repaired(damaged(conversations)).drop("roles")


def _oracle() -> str:
    moves = [(p, f"K{i}", q, 0, "") for (p, i), q in KEPT.items()] + [(p, "R", q, RECAST, role) for p, (q, role) in NEXT.items()] + [(p, "D", p, DELETE, "") for p in range(4)]
    inserts = [(p, p, 0, "", "") for p in range(4)]
    for p, (q, role) in NEXT.items():
        inserts.append((p, q, INSERT, "I", f"{role}:"))
        if p in (BEGIN, SYSTEM):
            inserts.append((p, NEXT[q][0], 2 * INSERT, "II", f"{role}:\n{NEXT[q][1]}:"))
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    blank = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE tab AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faulty AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
    FROM keyed, tab),
rows_after AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faulty, (SELECT unnest([1, 2]) AS copy) WHERE f != 0 AND (copy = 1 OR f = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_after),
told AS (
    SELECT *, rtrim(text, {blank}) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
    FROM numbered),
kinds AS (
    SELECT conv_id, n, turn, role, text, pair, body = '' AS blank, body != '' AND seen AS duplicate,
           body != '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated
    FROM told),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size
    FROM kinds GROUP BY conv_id),
moves(p, kind, q, c, given) AS (VALUES {quoted(moves)}),
inserts(p, q, c, e, t) AS (VALUES {quoted(inserts)}),
layers AS (
    SELECT conv_id, 0::BIGINT AS n, q AS state, c::BIGINT AS cost, e AS audit, t AS whole FROM counts, inserts WHERE p = 0
    UNION ALL
    SELECT conv_id, n, state, cost, audit, whole FROM (
        SELECT l.conv_id, k.n, i.q AS state, l.cost + m.c + i.c + CASE WHEN k.truncated AND m.kind != 'D' THEN {CUT} ELSE 0 END AS cost,
               l.audit || left(m.kind, 1) || i.e AS audit,
               concat_ws(chr(10), nullif(l.whole, ''), CASE left(m.kind, 1) WHEN 'K' THEN k.role || ':' || k.text WHEN 'R' THEN m.given || ':' || k.text END, nullif(i.t, '')) AS whole
        FROM layers l JOIN kinds k ON l.conv_id IS NOT DISTINCT FROM k.conv_id AND k.n = l.n + 1 JOIN moves m ON m.p = l.state JOIN inserts i ON i.p = m.q
        WHERE (m.kind = 'D' OR NOT (k.blank OR k.duplicate)) AND (left(m.kind, 1) != 'K' OR m.kind = 'K' || left(k.role, 1)))
    QUALIFY row_number() OVER (PARTITION BY conv_id, n, state ORDER BY cost, audit) = 1),
best AS (
    SELECT l.* FROM layers l JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.n = c.size
    WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY cost, audit) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON d.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()
