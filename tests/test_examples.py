from conftest import rows
from pyspark.sql import functions as F

from textfacts.functions import encoding as E
from textfacts.operators import examples as X
from textfacts.operators.report import length_aggregates


def test_vocabulary_order(spark):
    df = spark.createDataFrame([("b a b", "C"), ("c a", None)], "t string, u string").repartition(2)
    got = rows(X.build_vocabulary(df, ["t", "u"], 2).orderBy("token_id"))
    assert got == [("a", 2, 4), ("b", 2, 5)]
    assert X.vocabulary_list(X.build_vocabulary(df, ["t", "u"], 9)) == ["a", "b", "c"]


def test_encode(spark):
    df = spark.createDataFrame([(["b", "zz", "a"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [r[0] for r in rows(df.select(E.encode("t", ["a", "b"])))] == [[5, E.UNKNOWN_ID, 4], [], None]


def test_padding_masks_and_labels(spark):
    df = spark.createDataFrame([([7, 8, 9],), ([7],), ([],), ([1, 7],)], "ids array<int>").coalesce(1)
    got = rows(df.select(E.pad_ids("ids", 2), E.attention_mask("ids", 2), E.labels(E.pad_ids("ids", 2))))
    assert got == [
        ([7, 8], [1, 1], [7, 8]),
        ([7, 1], [1, 0], [7, -100]),
        ([1, 1], [0, 0], [-100, -100]),
        ([1, 7], [1, 1], [-100, 7]),
    ]
    assert rows(df.select(E.labels(E.pad_ids("ids", 2), mask=False)))[1] == ([7, 1],)


def test_training_examples(spark):
    df = spark.createDataFrame([(1, "A b c d", "b zz")], "id int, article string, summary string")
    row = X.training_examples(df, ["a", "b", "c", "d"], article_tokens=3, summary_tokens=4).first()
    assert row["input_ids"] == [4, 5, 6]
    assert row["attention_mask"] == [1, 1, 1]
    assert row["labels"] == [5, 3, -100, -100]
    assert "article" not in row.asDict()
    staged = X.training_examples(
        df, ["a", "b"], article_tokens=5, summary_tokens=4, char_limit=3, mask_labels=False, keep_text=True
    ).first()
    assert staged["input_ids"] == [4, 5, 1, 1, 1]  # three characters hold two words
    assert staged["labels"] == [5, 3, 1, 1]
    assert staged["article"] == "A b c d"


def test_padded_length(spark):
    df = spark.createDataFrame([(n,) for n in (1, 512, 513, 1024)], "n int").coalesce(1)
    assert [r[0] for r in rows(df.select(E.padded_length("n")))] == [512, 512, 1024, 1536]


def test_input_lengths_by_model(spark):
    df = spark.createDataFrame([(700,), (20_000,)], "n int").coalesce(1)
    models = {"LED-ArXiv": "allenai/led-large-16384-arxiv", "LongT5-Base": "google/long-t5-tglobal-base"}
    got = rows(X.with_input_lengths(X.per_model(df, models), "n").select("model_name", "input_length", "padded_length"))
    assert got == [
        ("LED-ArXiv", 700, 1024), ("LongT5-Base", 700, 700),
        ("LED-ArXiv", 16_384, 16_896), ("LongT5-Base", 1024, 1024),
    ]


def test_padding_overhead(spark):
    """Mean lengths of 537 and 791 are an overhead of 47.3 percent."""
    df = spark.createDataFrame(
        [("ok", 500, 700), ("ok", 574, 882), ("failed", 9, 9)], "status string, input_length int, padded_length int"
    )
    row = df.agg(*length_aggregates()).first()
    assert (row[0], row[1], round(row[2], 1)) == (537.0, 791.0, 47.3)
    none = df.where("status = 'none'").agg(*length_aggregates()).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_each_row_once_per_model_without_a_join(spark):
    df = X.per_model(spark.range(3))
    assert df.count() == 30
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(F.count_distinct("model_id")).first()[0] == 10
