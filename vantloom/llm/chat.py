"""Chat formatting with a grammar round trip.

Template: ``[INST] user [/INST]``, ``<s> assistant </s>``, ``<<SYS>> system <</SYS>>`` and
``[ROLE] name [TEXT] text [/TEXT]`` for any other role, one turn after the other. A turn is
rendered raw, reparsed by the deterministic parser and compared with its source; while they
differ, the control strings in its text (and those that look like escaped ones) get one more
backslash behind their first character. A control string never spans two places of the
template, since blanks stand on both sides of every text, so turns parse one by one just as
the whole conversation does.

A conversation may be of any length: the output has one row per turn, in order, and whatever
reads a conversation streams over its rows. Nothing is gathered by conversation.

Defined results: null text and null role are empty; null conv_id is a conversation of its own;
turns go by (turn, role, text), nulls first; repeated rows are all kept; an empty table gives
an empty table; ids are compared as they are, whatever their size; very long texts take memory in
proportion to the longest texts of a batch; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from vantloom.llm.batches import map_rows
from vantloom.runtime import ship, table

# The control strings of the template. All begin with < or [ and hold neither later,
# but for the double bracket of the system marks.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/TEXT]")

_control = re.compile("|".join(re.escape(c) for c in CONTROL))
_like = re.compile(r"([<\[])(\\*)(?=(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\]))")
_escaped = re.compile(r"([<\[])\\(\\*)(?=(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\]))")


def escape(text: str) -> str:
    return _like.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end bound the text as formatted."""
    out, at = [], 0

    def expect(mark: str) -> None:
        nonlocal at
        if not formatted.startswith(mark, at):
            raise ValueError(f"expected {mark!r} at {at}")
        at += len(mark)

    def until(mark: str) -> tuple[int, int]:
        nonlocal at
        begin, m = at, _control.search(formatted, at)
        end = m.start() - 1 if m else -1
        if end < begin or not formatted.startswith(mark, end):
            raise ValueError(f"expected {mark!r} after {begin}")
        at = end + len(mark)
        return begin, end

    while at < len(formatted):
        for role, (head, tail) in MARKS.items():
            if formatted.startswith(head, at):
                expect(head)
                a, b = until(tail)
                out.append((role, unescape(formatted[a:b]), a, b))
                break
        else:
            expect(OTHER[0])
            a, b = until(OTHER[1])
            role = unescape(formatted[a:b])
            a, b = until(OTHER[2])
            out.append((role, unescape(formatted[a:b]), a, b))
    return out


def render_raw(role: str, text: str) -> str:
    if role in MARKS:
        head, tail = MARKS[role]
        return head + text + tail
    return OTHER[0] + role + OTHER[1] + text + OTHER[2]


def _recovers(formatted: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(formatted)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """The shortest rendering on the ladder raw, text escaped, both escaped that parses back."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        formatted = render_raw(r, t)
        if _recovers(formatted, role, text):
            return formatted
    raise AssertionError("the escaped form parses back for every turn")


def render_conversation(turns: list[tuple[str, str]]) -> str:
    return "".join(render(r, t) for r, t in turns)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_end), one row per turn.

    The formatted conversation is the concatenation of ``formatted`` by (turn, role, text);
    loss_start and loss_end bound the text under the loss mask within the row, null if none.
    """
    kinds = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def fn(convs, turns, roles, texts):
        formatted = [render(r, t) for r, t in zip(roles, texts)]
        spans = [parse(f)[0][2:] if r == "assistant" else (None, None) for f, r in zip(formatted, roles)]
        return convs, turns, roles, texts, formatted, [s[0] for s in spans], [s[1] for s in spans]

    return map_rows(rows, lambda: fn, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string, loss_start bigint, loss_end bigint")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests read back from ``format_turns``: rows stream by conversation in constant memory."""
    kind = dict(turns.dtypes)["conv_id"]
    parsed = _parse_datatype_string(f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(parsed)
        state, current = None, None
        for batch in batches:
            done = []
            for conv, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        done.append(_close(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    masked = unescape(formatted[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(formatted)
            if done:
                yield _rows(done, arrow)
        if state is not None:
            yield _rows([_close(current, state)], arrow)

    ship(turns.sparkSession)
    return ordered.mapInArrow(run, parsed)


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)


def _close(conv, state):
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(format_turns(rows.unionByName(probe)))


OP1_SQL = r"""
WITH probe(conv_id, turn, role, text) AS (
  VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM probe
), sized AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\])', '\1\\\2\3', 'g') AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 24 + length(role) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
