import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts.llm import chat

HARD = ["\\### Assistant: </turn> ok", "</turn>", "### ", "a\\e</turn>\\l", "\\", "", "\n\n", "x: y: ", "#### user: hi", "</turn", "<</turn>/turn>", "\\h## ", "é" * 5 + "\U0001f600"]


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_any_text_and_role_reads_back(spark):
    data = [(i, j, role, text) for i, role in enumerate([*HARD, "user", "assistant"]) for j, text in enumerate(HARD)]
    read = chat.read_conversations(chat.format_conversations(frame(spark, data)))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    assert got == {i: [(role, text) for text in HARD] for i, role in enumerate([*HARD, "user", "assistant"])}


def test_only_conflicting_turns_are_escaped(spark):
    data = [(1, 0, "user", "plain: text"), (1, 1, "assistant", "a </turn> b")]
    text = chat.format_conversations(frame(spark, data)).first()["formatted"]
    assert text == "### user: plain: text</turn>### \\assistant: a \\l/turn> b</turn>"


def test_text_under_the_mask(spark):
    data = [(1, 0, "system", "s"), (1, 1, "assistant", "one </turn>"), (1, 2, "user", "u"), (1, 3, "assistant", "two"), (2, 0, "user", "no answer")]
    read = chat.read_conversations(chat.format_conversations(frame(spark, data)))
    got = read.select("conv_id", chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    assert sorted(rows(got)) == [(1, "one </turn>two"), (2, "")]


def test_nulls_ties_and_repeated_rows(spark):
    data = [(None, None, None, None), (None, 1, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, "z")]
    extra = frame(spark, data).withColumns({"formatted": F.lit("clash"), "piece": F.lit(1)})
    read = chat.read_conversations(chat.format_conversations(extra))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    assert got == {None: [("", ""), ("user", "a")], 1: [("", "z"), ("user", "a"), ("user", "a"), ("user", "b")]}


def test_empty_table(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0


def test_a_long_conversation(spark):
    data = [(1, i, "assistant" if i % 2 else "user", f"</turn> {i} " + "x" * 500) for i in range(3000)]
    read = chat.read_conversations(chat.format_conversations(frame(spark, data)))
    got = read.select(F.size("turns"), F.sha2(chat.under_mask(F.col("formatted"), F.col("loss_mask")), 256)).first()
    assert tuple(got) == (3000, hashlib.sha256("".join(t for _, _, r, t in data if r == "assistant").encode()).hexdigest())


def test_no_python_in_the_plan(spark, folder):
    plan = chat.op3_chat(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("name", ["op3_chat", "op4_warc"])
def test_same_rows_as_duckdb(spark, folder, name):
    from check_oracle import compare, connect

    assert compare(spark, connect(folder), folder, name)[0] == "equal"
