import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm.chat_format import escape, format_conversations, format_turns, read_back, unescape

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", " ", "\\", "<", "[", "/s>", "INST]", "a", "\n", "漢"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n long")
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.round_trip) == (len(turns), digest(said), len(loss), digest(loss), True)
    assert len(got) == len({r[0] for r in rows})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=40, max_size=40))
def test_any_text_comes_back(spark, texts):
    check(spark, [(i // 4, i % 4, ["system", "user", "assistant", "assistant"][i % 4], t, "x", 1) for i, t in enumerate(texts)])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "", 0), (1, 1, "assistant", "", "", 0), (2, 5, None, "a", "", 0), (2, 5, "user", "a", "", 0), (None, 0, "assistant", "x" * 50_000, "", 0), (3, None, "assistant", "q", "", 0), (3, 0, "we[INST]ird", "</s>", "", 0)]
    check(spark, rows)


def test_only_conflicts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain < [text]"), (1, 1, "user", r"<\s>")], "conv_id long, turn long, role string, text string")
    assert [r.escaped for r in format_turns(df).orderBy("turn").collect()] == [False, True]


@pytest.mark.parametrize("text", ["</s>", r"<\/s>", r"[\\INST] <\s>", "<<s>>"])
def test_escape_is_reversible(spark, text):
    r = spark.range(1).select(escape(F.lit(text)).alias("e"), unescape(escape(F.lit(text))).alias("u")).first()
    assert r.u == text and r.e != text


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
