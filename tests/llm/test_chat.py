import hashlib
import random

import pytest

from vantloom.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[", "<", "\\", "[/INST]", " ", "x", "INST]", "s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]", "\n", "<\\s>"]
ROLES = ["user", "assistant", "system", "tool", "", "<s>x", "a [TEXT] b", "[\\TEXT]"]


def test_every_conversation_parses_back():
    rnd = random.Random(3)
    for _ in range(5000):
        turns = [(rnd.choice(ROLES), "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 7)))) for _ in range(rnd.randint(0, 4))]
        assert [t[:2] for t in chat.parse(chat.render_conversation(turns))] == turns


def test_plain_text_is_left_alone_and_conflicts_are_escaped():
    assert chat.render("user", "hello [x] <b>") == "[INST] hello [x] <b> [/INST]"
    assert chat.render("user", chat.PROBE) == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"
    with pytest.raises(ValueError):
        chat.parse("[INST] never closed")


def test_digests_against_plain_python(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "z"), (1, None, "tool", "</s>"), (2, 5, "assistant", ""), (2, 5, "assistant", ""),
            (None, 1, "user", "q"), (3, 0, "assistant", "long " * 50_000), (3, 1, "assistant", chat.PROBE)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted")
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        formatted = chat.render_conversation([(r, x) for _, r, x in turns])
        row = found[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == len(formatted)
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_large_ids_beside_a_null_stay_apart(spark):
    rows = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (2**53 + 1, 1, "assistant", "c"), (None, 0, "user", "d")]
    for df in (spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("'id' || conv_id AS conv_id", "turn", "role", "text")):
        found = chat.conversation_digests(chat.format_turns(df.coalesce(1))).collect()
        assert sorted((str(r.conv_id).removeprefix("id"), r.n_turns) for r in found) == [(str(2**53), 1), (str(2**53 + 1), 2), ("None", 1)]


def test_query_holds_the_probe(spark, sf):
    rows = {r.conv_id: r for r in chat.op1_chat_format(spark, sf).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(chat.PROBE)
    assert rows[-1].loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
