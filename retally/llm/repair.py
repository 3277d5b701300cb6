"""Repair of conversations at least cost, by a Viterbi search with survivor coalescence.

A conversation may start with a system turn, then user and assistant alternate, the assistant
last; nothing at all is right too. Each row is kept, gets another role or is deleted, and empty
turns may be inserted anywhere; the cheapest edits win, of equal ones the least audit string
(the initials of the edits in order).

The search goes over the rows of a conversation once. After each row it has one survivor for
each state (nothing yet, system, user or assistant last), the cheapest way there. Survivors are
leaves of a tree of backpointers; a node is freed when the last survivor behind it is gone, and
edits are given out as soon as all survivors share them, so memory holds the rows on which
survivors still differ, not the conversation. Survivors of equal cost differ in audits that are
still open as a whole: no two of them are alike or begin one another (all have the same number
of rows and end with one), so their order stays what it was where they parted, and is carried
along as the survivors' rank.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of edits, and of a truncated row that is not deleted.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters around words, and those that end a complete text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: States: nothing yet, system, user or assistant was last. Roles by initial, and where each leads.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_LEADS = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_NAMES = {"u": "user", "a": "assistant"}
#: What a row may be: faults that must go, faults that cost, none.
MUST_GO, COSTS, GOOD = range(3)

State = tuple[tuple[int, int], ...]  #: survivors, least audit first: state and cost above the least


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """State, cost and audit after no insert or some; a third one would only lead back."""
    out = [(state, 0, "")]
    for times in (1, 2):
        state = next(to for (at, name), to in _LEADS.items() if at == state and name != "s")
        out.append((state, times * INSERT, "I" * times))
    return out


def _row_edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str]]:
    """State, cost and audit of the edits of one row."""
    for at, cost, audit in _inserted(state):
        yield at, cost + DELETE, audit + "D"
        if fault == MUST_GO:
            continue
        cost += TRUNCATED if fault == COSTS else 0
        for role in "sua":
            to = _LEADS.get((at, role))
            if to is not None and role == initial:
                yield to, cost, audit + "K"
            elif to is not None and role != "s":
                yield to, cost + RENAME, audit + "R"


#: What it costs at most to go on from one state as another one could: from an assistant turn a
#: system row that would start the conversation is deleted; inserts lead to the rest.
_BEHIND = {
    (_ASSISTANT, _START): DELETE, (_ASSISTANT, _SYSTEM): 0, (_ASSISTANT, _USER): INSERT,
    (_START, _SYSTEM): 0, (_START, _USER): INSERT, (_START, _ASSISTANT): 2 * INSERT,
    (_SYSTEM, _USER): INSERT, (_SYSTEM, _ASSISTANT): 2 * INSERT,
    (_USER, _ASSISTANT): INSERT, (_USER, _SYSTEM): INSERT, (_USER, _START): INSERT + DELETE,
}


@cache
def _step(survivors: State, initial: str, fault: int) -> tuple[State, tuple[tuple[int, str], ...]]:
    """Survivors after one row, and for each its parent's place and the edits that lead to it."""
    best: dict[int, tuple] = {}
    for parent, (state, cost) in enumerate(survivors):
        for to, more, audit in _row_edits(state, initial, fault):
            found = (cost + more, parent, audit)
            if to not in best or found < best[to]:
                best[to] = found
    costs = {state: found[0] for state, found in best.items()}
    kept = [s for s in best if not any(costs[o] + _BEHIND[o, s] < costs[s] for o in costs if (o, s) in _BEHIND)]
    kept.sort(key=lambda s: best[s][1:])
    least = min(costs[s] for s in kept)
    return tuple((s, costs[s] - least) for s in kept), tuple(best[s][1:] for s in kept)


@cache
def _last(survivors: State) -> tuple[int, str]:
    """Place of the survivor that wins, and the inserts behind its last row."""
    ends = []
    for place, (state, cost) in enumerate(survivors):
        for at, more, audit in _inserted(state):
            if at in (_START, _ASSISTANT):
                ends.append((cost + more, place, audit))
    return min(ends)[1:]


class _Node:
    """The edits of one row as one survivor has them; ``uses`` counts what is behind it."""

    __slots__ = ("parent", "audit", "uses")

    def __init__(self, parent: _Node | None, audit: str):
        self.parent, self.audit, self.uses = parent, audit, 0
        if parent is not None:
            parent.uses += 1


def _release(node: _Node) -> None:
    """Frees a node nothing is behind, and those before it that only led here."""
    while node is not None and node.uses == 0:
        parent, node.parent = node.parent, None
        if parent is not None:
            parent.uses -= 1
        node = parent


class Search:
    """The edits of one conversation. ``add`` takes the next row and gives the edits of rows that
    are settled by now, ``close`` those of the others."""

    def __init__(self):
        self.survivors: State = ((_START, 0),)
        self.leaves = [_Node(None, "")]
        self.settled = self.leaves[0]

    def add(self, initial: str, fault: int) -> list[str]:
        initial = initial if initial in ("s", "u", "a") else ""
        self.survivors, ways = _step(self.survivors, initial, fault)
        before = self.leaves
        self.leaves = [_Node(before[parent], audit) for parent, audit in ways]
        for node in before:
            if node.uses == 0:
                _release(node)
        return self._shared() if self.settled.uses == 1 else []

    def _shared(self) -> list[str]:
        """Edits between the last settled node and the last one that all survivors are behind."""
        path, node = [], self.leaves[0]
        while node is not self.settled:
            path.append(node)
            node = node.parent
        out = []
        while path and node.uses == 1:
            node = path.pop()
            out.append(node.audit)
            node.parent = None  # what is settled is no longer needed
        self.settled = node
        return out

    def close(self) -> list[str]:
        place, inserts = _last(self.survivors)
        out, node = [], self.leaves[place]
        while node is not self.settled:
            out.append(node.audit)
            node = node.parent
        return [*reversed(out), inserts]


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` of ``rows`` and each row's first fault, or null: ``blank``
    (nothing but blanks), ``duplicate`` (role and text stand in an earlier row, or in the row before
    of the same turn), ``truncated`` (does not end with a full stop or the like).

    Rows of one conversation stand together and in order: by turn, nulls first, then role and text.
    Null roles and texts count as one blank. Null ids are one conversation.
    """
    blank = F.lit(" ")
    chosen = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    ).withColumn("digest", F.md5("text"))
    # Copies within a turn stand next to each other after sorting; only those of other turns are looked up.
    at = F.struct(F.col("turn").isNotNull(), "turn")
    where = chosen.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    again = where.where("first < last").select(
        F.col("conv_id").alias("_id"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"
    )
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.coalesce(F.col("first") < at, F.lit(False)), "duplicate")
        .when(~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated")
    )
    found = chosen.join(again, same, "left").select("conv_id", "turn", "role", "text", fault.alias("fault"))
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _edits_schema(rows: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("conv_id", rows.schema["conv_id"].dataType),
            T.StructField("step", T.LongType()),
            T.StructField("edit", T.StringType()),
            T.StructField("fault", T.StringType()),
            T.StructField("turn", rows.schema["turn"].dataType),
            T.StructField("role", T.StringType()),
            T.StructField("new_role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )


#: Text characters of edits that wait for an Arrow batch.
_BATCH = 1 << 20


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``; other columns
    are not read): one row per edit, those of a conversation together and in order (``step``).

    ``edit`` is K (kept), R (another role), D (deleted) or I (an empty turn inserted); ``fault`` is
    the row's (see ``with_faults``), ``new_role`` the role it has now, null if it is deleted. Blank and
    duplicate rows are always deleted. A role counts by its first letter; those of other letters
    cannot be kept. Repeated rows are duplicates. An empty table has no edits.

    One conversation is read by one task as a stream; only rows on which survivors differ are in
    memory. That is a few, but all rows since then if two ways stay equally cheap, as when
    only users speak, a row too many.
    """
    schema = _edits_schema(rows)
    kinds = {"blank": MUST_GO, "duplicate": MUST_GO, "truncated": COSTS, None: GOOD}
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        key, search, waits, step, emits = None, None, deque(), 0, ""
        before, out, size = None, [], 0

        def give(audits: list[str]) -> None:
            nonlocal step, emits, size
            for audit in audits:
                for edit in audit:
                    if edit == "I":
                        turn, role, text, fault = None, None, "", None
                    else:
                        turn, role, text, fault = waits.popleft()
                    new = role if edit == "K" else None
                    if edit in "RI":
                        new = "assistant" if emits in ("u",) else "user"
                    if new is not None:
                        emits = new[:1]
                    out.append((key, step, edit, fault, turn, role, new, text))
                    step += 1
                    size += len(text) + 64

        def packed() -> pa.RecordBatch:
            nonlocal out, size
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
            out, size = [], 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if arrow is None:
                ids, turns = batch.schema.field(0).type, batch.schema.field(1).type
                text = pa.string()
                arrow = [pa.field(n, t) for n, t in zip(names, (ids, pa.int64(), text, text, turns, text, text, text))]
            for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if search is None or conv_id != key:
                    if search is not None:
                        give(search.close())
                    key, search, step, emits, before = conv_id, Search(), 0, "", None
                row = (turn, role, text)
                if fault in (None, "truncated") and row == before:
                    fault = "duplicate"
                before = row
                waits.append((turn, role, text, fault))
                give(search.add(role[:1], kinds[fault]))
                if size > _BATCH:
                    yield packed()
        if search is not None:
            give(search.close())
        if out:
            yield packed()

    return with_faults(rows).mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` of ``rows`` with faults by a hash of id and turn: a twentieth
    each is dropped, emptied, loses its ends of sentences, is repeated, is said by the user. Nulls
    are one blank, turns and ids stay null."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    made = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("times")
    )
    return made.select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time")


DIGESTS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)
#: Neighbouring initials that are in order.
_LEGAL = {"su", "ua", "au"}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits, which come together and in order."""
    import hashlib

    names = [n.split()[0] for n in DIGESTS.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    key, at, out = None, None, []

    class Totals:
        def __init__(self):
            self.turns, self.low, self.high, self.turn = 0, None, None, None
            self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.illegal, self.cost, self.initial = 0, 0, None
            self.audit, self.sha, self.any = [], hashlib.sha256(), False

        def row(self) -> tuple:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    costs = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}
    for batch in batches:
        for conv_id, _, edit, fault, turn, role, new, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or conv_id != key:
                if at is not None:
                    out.append(at.row())
                key, at = conv_id, Totals()
            at.audit.append(edit)
            at.cost += costs[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault is not None:
                    at.faults[fault] += 1
                if at.initial is not None and at.initial + role[:1] not in _LEGAL:
                    at.illegal += 1
                at.initial = role[:1]
                if turn is not None and turn != at.turn:
                    at.low = turn if at.low is None else at.low
                    at.high, at.turn, at.turns = turn, turn, at.turns + 1
            if new is not None:
                at.sha.update(f"{chr(10) if at.any else ''}{new}:{text}".encode())
                at.any = True
        if len(out) > 10_000:
            yield packed()
            out = []
    if at is not None:
        out.append(at.row())
    if out:
        yield packed()


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows``, after ``damage``: its faults, the cost and audit of its repair and a
    digest of the repaired turns. Conversations that lost all rows have zeros and empty strings."""
    chosen = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    found = repair(damage(chosen)).mapInArrow(_summed, DIGESTS)
    every = chosen.select(F.col("conv_id").alias("_id")).distinct()
    both = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    names = found.columns[1:]
    empty = {**{n: F.lit(0) for n in names}, "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return both.select(F.col("_id").alias("conv_id"), *[F.coalesce(n, empty[n]).alias(n) for n in names])


_TRIMMED = "rtrim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: The same by a recursion over rows that carries whole audits and repaired turns.
ORACLE = f"""
WITH RECURSIVE
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295::BIGINT) % 20 AS kind
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time
  FROM kinds),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN {_TRIMMED.format("text")} = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right({_TRIMMED.format("text")}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM numbered),
leads AS (
  SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) t(q, r, nxt)),
added AS (
  SELECT * FROM (VALUES
    ('', '', 0, '', []::VARCHAR[]), ('', 'u', 5, 'I', ['user:']), ('', 'a', 10, 'II', ['user:', 'assistant:']),
    ('s', 's', 0, '', []), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
    ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']), ('u', 'u', 10, 'II', ['assistant:', 'user:']),
    ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:']), ('a', 'a', 10, 'II', ['user:', 'assistant:'])) t(q, p, plus, marks, made)),
edits AS (
  SELECT a.q, a.plus, a.marks, a.made, a.p AS nxt, 'D' AS edit, '' AS r FROM added a
  UNION ALL
  SELECT a.q, a.plus, a.marks, a.made, l.nxt, e.edit, l.r FROM added a JOIN leads l ON l.q = a.p
  CROSS JOIN (VALUES ('K'), ('R')) e(edit) WHERE e.edit = 'K' OR l.r <> 's'),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}} AS way
  FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT w.conv_id, f.i, e.nxt,
    min({{'cost': w.way.cost + e.plus
        + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
      'audit': w.way.audit || e.marks || e.edit,
      'turns': w.way.turns || e.made || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
        ELSE [CASE e.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END}})
  FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN edits e ON e.q = w.q
  WHERE e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.r = f.initial))
  GROUP BY w.conv_id, f.i, e.nxt),
totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, min({{'cost': w.way.cost + a.plus, 'audit': w.way.audit || a.marks, 'turns': w.way.turns || a.made}}) AS way
  FROM ways w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN added a ON a.q = w.q
  WHERE a.p IN ('', 'a') GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank,
  coalesce(t.duplicate, 0)::BIGINT AS duplicate, coalesce(t.truncated, 0)::BIGINT AS truncated,
  coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit,
  sha256(coalesce(array_to_string(e.way.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
