"""Chat formatting by a template that is a black box, with spans and a loss mask.

A template is a function from messages (pairs of role and text) to one string. Successive
prefixes of a conversation are rendered and neighbours compared: what the longer output adds
is the new turn's span, and a template whose output for a prefix changes afterwards is found
out. A turn's text is located by rendering the turn once more with a mark in its place that no
message of the conversation holds. A conversation of n turns costs n renderings of its prefixes, as nothing is known of the
template; memory holds one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: Strings that steer the default template; ``instruction_template`` escapes them in texts.
CONTROLS = r"</?s>|\[/?INST\]|\[/?ROLE\]|\[/TURN\]"
_ESCAPED = re.compile(rf"\\|[<\[](?=(?<=<)/?s>|(?<=\[)(?:/?INST\]|/?ROLE\]|/TURN\]))")
_UNESCAPED = re.compile(r"\\(\\?)")
_EDGE, _INSIDE = "\ue000", "\ue001"


def escape(text: str) -> str:
    """Doubles backslashes and breaks control strings with one behind their first character."""
    return _ESCAPED.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def instruction_template(messages: list[Message]) -> str:
    """``<s>``, then each turn: user ``[INST] text [/INST]``, assistant `` text </s>``, any other
    role ``[ROLE]role[/ROLE] text [/TURN]``."""
    out = ["<s>"]
    for role, text in messages:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {escape(text)} [/TURN]")
    return "".join(out)


def mark_for(messages: list[Message]) -> str:
    """A text that stands nowhere in the messages, also not across their edges: a run of one code
    point that is longer than any of theirs, between two others."""
    inside = _INSIDE
    while any(inside in part for message in messages for part in message):
        inside += _INSIDE
    return _EDGE + inside + _EDGE


def spans(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The formatted conversation, per turn (start, stop, start of its text, stop of its text) in
    code points, and whether the template rewrote what it had given for a shorter prefix.

    A turn whose prefix was rewritten starts where the outputs first differ.
    """
    shorter, found, rewritten, mark = template([]), [], False, mark_for(messages)
    for i, (role, _) in enumerate(messages):
        longer = template(messages[: i + 1])
        start = len(shorter)
        if not longer.startswith(shorter):
            rewritten = True
            start = next((k for k, (a, b) in enumerate(zip(shorter, longer)) if a != b), min(len(shorter), len(longer)))
        marked = template([*messages[:i], (role, mark)])
        at = marked.find(mark, min(start, len(marked)))
        behind = len(marked) - at - len(mark)
        inside = (at, max(at, len(longer) - behind)) if at >= 0 else (start, start)
        found.append((start, len(longer), *inside))
        shorter = longer
    return shorter, found, rewritten


FORMATTED = (
    "conv_id bigint, formatted string, rewritten boolean,"
    " turns array<struct<role:string,start:int,stop:int,text_start:int,text_stop:int,loss:boolean>>"
)
_TURNS = pa.list_(
    pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "stop", "text_start", "text_stop")), ("loss", pa.bool_())])
)


def format_conversations(rows: DataFrame, template: Template = instruction_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted string per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Turns are in ascending order, nulls first, equal ones by role and text; repeated rows are
    turns of their own. Null texts and roles are empty. Rows without ``conv_id`` are one
    conversation. ``turns`` holds the spans; those with ``loss`` make the loss mask.
    """
    empty = F.lit("")
    chosen = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def made(conv_id, messages: list[Message]) -> tuple:
        text, where, rewritten = spans(messages, template)
        turns = [
            {"role": role, "start": a, "stop": b, "text_start": c, "text_stop": d, "loss": role in loss_roles}
            for (role, _), (a, b, c, d) in zip(messages, where)
        ]
        return conv_id, text, rewritten, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, messages, out, size = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if messages and conv_id != key:
                    out.append(made(key, messages))
                    messages, size = [], size + len(out[-1][1])
                    if size > 1 << 22:
                        yield _batch(out)
                        out, size = [], 0
                key = conv_id
                messages.append((role, text))
        if messages:
            out.append(made(key, messages))
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.bool_(), _TURNS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "formatted", "rewritten", "turns"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the turns as they stand in the output: ``messages``, an array of role,
    text and whether the text is under the loss mask. Roles come from the turn's own marks."""
    text = lambda a, b: F.substring("formatted", a + 1, b - a)
    plain = lambda c: F.regexp_replace(c, r"\\(\\?)", "$1")

    def message(turn: F.Column) -> F.Column:
        head = text(turn["start"], turn["text_start"])
        named = plain(F.regexp_extract(head, r"(?s)\[ROLE\](.*)\[/ROLE\] $", 1))
        role = F.when(head.endswith("[INST] "), "user").when(head.endswith("[/ROLE] "), named).otherwise("assistant")
        return F.struct(role.alias("role"), plain(text(turn["text_start"], turn["text_stop"])).alias("text"), turn["loss"].alias("loss"))

    return formatted.withColumn("messages", F.transform("turns", message))


#: A conversation whose texts are control strings, added under the id -1 by the query.
PLANTED_ID, PLANTED = -1, "</s>[INST] ok [/INST]"


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, and for the planted one: what is read back from the formatted string."""
    planted = rows.sparkSession.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    every = rows.select("conv_id", "turn", "role", "text").unionByName(planted)
    found = read_back(format_conversations(every))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m["loss"]), lambda m: m["text"]), "")
    return found.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_LENGTH = rf"(length({{0}}) + len(regexp_extract_all({{0}}, '\\|{CONTROLS}')))"

ORACLE = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED}'
  UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED}'),
sized AS (
  SELECT *, {_LENGTH.format("text")} AS written,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 22 + {_LENGTH.format("role")} END AS marks
  FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(written + marks))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
