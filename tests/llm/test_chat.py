import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtally.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
_control = st.text(alphabet="<|\\\nimstartendp_>ok é😀 ", max_size=20)
_text = st.one_of(_control, st.sampled_from([chat.START, chat.PART, chat.END, "<\\|", ""]))


def _read(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).select(
        "*",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"),
    )
    return {r.conv_id: r for r in out.collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\n", "<|x"]), _text), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(i % 3, i, role, text) for i, (role, text) in enumerate(turns)]
    for conv, out in _read(spark, rows).items():
        own = [(r, t) for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in out.turns] == own
        assert out.loss_text == "".join(t for r, t in own if r == "assistant")
        # Only the template holds markers.
        assert len(re.findall(r"<\|im_start\|>", out.formatted)) == out.n_blocks


def test_neighbours_of_one_role_are_merged(spark):
    rows = [(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    out = _read(spark, rows)[1]
    assert out.formatted == (
        "<|im_start|>user\na<|im_part|>b<|im_end|>\n"
        "<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    )
    assert out.n_blocks == 3
    assert [out.formatted[s.start : s.end] for s in out.loss] == ["c"]


def _seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_long_conversations_are_read_in_linear_time(spark):
    def read(n):
        turns = spark.range(n).selectExpr(
            "1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
            "concat(repeat('word ', 30), id, ' <|im_part|>') as text",
        )
        out = chat.format_conversations(turns)
        text = chat.loss_text(F.col("formatted"), F.col("loss"))
        row = out.select(F.size(chat.read_turns(F.col("formatted"))), F.length(text)).first()
        assert row[0] == n and row[1] > n // 2 * 150

    read(100)
    few, many = (_seconds(lambda: read(n)) for n in (2_000, 16_000))
    assert many < 10 * few + 1


def test_mask_that_is_not_the_texts_is_cut_out(spark):
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "xyz")], SCHEMA))
    other = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(17).alias("start"), F.lit(20).alias("end")))
    assert out.select(chat.loss_text(F.col("formatted"), other)).first()[0] == "<|abc"


def test_rows_without_a_conversation_are_not_pooled(spark):
    rows = [(None, i % 3, "user", f"t{i}") for i in range(3_000)] + [(1, 0, "user", "x")] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    out = chat.format_conversations(frame).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    alone = [r.t for r in out if r.conv_id is None]
    assert sorted(t[0].text for t in alone) == sorted(f"t{i}" for i in range(3_000))
    assert [len(r.t) for r in out if r.conv_id == 1] == [2]


def test_edges(spark):
    out = _read(spark, [(None, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x")])
    assert [tuple(t) for t in out[None].turns] == [("", "")]
    assert out[2].loss_text == "xx"
    assert _read(spark, []) == {}
    many = _read(spark, [(3, i, "user" if i % 2 else "assistant", "w" * (i % 9)) for i in range(2000)])
    assert len(many[3].turns) == 2000
    wide = spark.createDataFrame([(1, 0, "user", "a", 5, "y")], f"{SCHEMA}, turns long, formatted string")
    assert chat.format_conversations(wide).first().formatted == "<|im_start|>user\na<|im_end|>\n"


@pytest.mark.parametrize("text", ["<|", "<\\|", "a<\\\\|b<|", "plain \\ | <"])
def test_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")
    ).first()
    assert "<|" not in row.e
    assert row.u == text
