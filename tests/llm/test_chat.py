from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
PIECES = st.sampled_from(["<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "\n", "a", "é", "<\\|im_end|>", "|im_end|>"])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_digest_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "</s>[INST] x"), (2, 0, "assistant", "</s>[INST] x"),
            (3, None, None, None), (None, 1, "user", "a<|im_start|>system<|im_sep|>b"), (4, 2, "tool", "x" * 50_000),
            (5, 1, "assistant", "second"), (5, 0, "user", "first")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == expected(rows)


def test_rows_without_conversation_stay_apart(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")] * 30
    got = chat.digest(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 90 and all(r.n_turns == 1 and r.segments == 3 for r in got)
    assert {(r.state, r.valid) for r in got} == {("user", False), ("invalid", False)}


def test_a_broken_turn_order_shows_in_the_digest(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q")]
    got = {r.conv_id: (r.state, r.valid, r.segments) for r in chat.digest(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: ("invalid", False, 6), 2: ("assistant", True, 6), 3: ("user", False, 3)}


def test_machine(spark):
    rows = [(1, 0, "system", ""), (1, 1, "user", ""), (1, 2, "assistant", ""), (2, 0, "user", ""), (3, 0, "assistant", ""), (3, 1, "user", ""),
            (4, 0, "user", ""), (4, 1, "user", "")]
    got = {r.conv_id: (r.state, r.valid) for r in chat.format_conversations(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: ("assistant", True), 2: ("user", False), 3: ("invalid", False), 4: ("invalid", False)}


def test_spans_and_segments(spark):
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "é</s>")], ROWS)).collect()[0]
    assert "".join(s.text for s in r.segments) == r.formatted
    assert [r.formatted[s.start:s.start + s.chars] for s in r.loss_spans] == ["é<\\/s>"]


def test_escape_is_reversible(spark):
    texts: list[str] = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(PIECES, max_size=8).map("".join))
    def draw(t):
        texts.append(t)

    draw()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F
    esc = chat.escape(F.col("t"))
    rows = df.select("t", esc.alias("e"), chat.unescape(esc).alias("u")).collect()
    controls = (chat.CHATML.open, chat.CHATML.sep, chat.CHATML.close, *chat.CHATML.controls)
    assert all(r.t == r.u and not any(c in r.e for c in controls) for r in rows)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F
    assert chat.digest(spark.createDataFrame([], ROWS)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "q")], ROWS).withColumns({"_t": F.lit(1), "segments": F.lit(2), "state": F.lit(3)})
    assert chat.digest(rows).count() == 1


def test_bad_template():
    with pytest.raises(ValueError):
        chat.Template(open="<<x>>")
