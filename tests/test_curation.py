from pathlib import Path

import pytest
from conftest import rows

from textfacts import constants as C
from textfacts.operators import curation as cur
from textfacts.operators.grouping import concat_documents
from textfacts.plans.curation import prepare_dataset, split_articles
from textfacts.sources import tables


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def raw(spark):
    good = (words(120), words(60), "A fine headline", "news", "2020-01-02")
    data = [
        good, good, good,
        (words(120), words(60), "A fine headline", None, "2020-01-02"),
        (words(120), words(60), "A fine headline", None, "2020-01-02"),
        (None, words(60), "A fine headline", "news", "2020-01-01"),
        (words(120), None, "A fine headline", "news", "2020-01-01"),
        (words(120), words(60), None, "news", "2020-01-01"),
        (words(120), words(49), "A fine headline", "news", "2020-01-03"),
        (words(120), words(50), "A fine headline", "news", "2020-01-03"),
        (words(400), words(250), "A fine headline", "sport", None),
        (words(400), words(251), "A fine headline", "sport", "2020-01-04"),
        (words(99), words(60), "A fine headline", "sport", "2020-01-05"),
        (words(100), words(60), "ten chars!", "sport", "2020-01-05"),
        (words(100), words(60), "nine char", "sport", "2020-01-06"),
    ]
    names = [" article_text", "human_summary ", "head\nline", "news_category", "published_date"]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names)).repartition(3)


def test_headers(raw):
    assert cur.standard_columns(raw).columns == ["article", "summary", "headline", "category", "date"]


def test_funnel(raw):
    assert [r["n_rows"] for r in cur.filter_funnel(raw).orderBy("step_no").collect()] == [15, 12, 9, 7, 6, 5]


def test_funnel_of_nothing(raw):
    got = cur.filter_funnel(raw.where("false")).orderBy("step_no")
    assert [r["n_rows"] for r in got.collect()] == [0] * 6


def test_curate_keeps_what_the_funnel_counts(raw):
    kept = cur.curate(raw)
    assert kept.count() == 5
    assert kept.select("row_key").distinct().count() == 5


def test_each_word_count_is_made_once(raw):
    plan = cur.curate(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_statistics_and_targets(spark):
    curated = spark.createDataFrame(
        [(330, 95, "a"), (338, 96, "b"), (334, 95, None)],
        "article_word_count int, summary_word_count int, category string",
    )
    stats = cur.corpus_statistics(curated)
    row = stats.first()
    assert (row["n_articles"], row["n_categories"], row["avg_article_words"]) == (3, 2, 334.0)
    got = {r["metric"]: r["matches"] for r in cur.check_targets(stats).collect()}
    assert got == {"n_articles": False, "avg_article_words": True, "avg_summary_words": True, "compression_ratio": True}


def test_tolerance_is_open_ended(spark):
    stats = spark.createDataFrame([(344.21, 3.0)], "avg_article_words double, n_articles double")
    got = cur.check_targets(stats, [("avg_article_words", 334.21, 10.0), ("n_articles", 3.0, 0.0)])
    assert {r["metric"]: r["matches"] for r in got.collect()} == {"avg_article_words": False, "n_articles": True}


def test_prepare_dataset_writes_the_splits(spark, raw, fresh):
    path = fresh("splits")
    prepare_dataset(raw, path, cap=4)
    table = spark.read.parquet(path)
    assert sorted(r["split"] for r in table.collect()) == ["test", "train", "train", "train"]
    assert tables.read_split(spark, path, "train").count() == 3
    assert tables.read_split(spark, path, "train", small=True).count() == 3
    # the undated article sorts last, so the cap drops it
    assert table.where("date is null").count() == 0


def test_reading_a_split_opens_only_its_folder(spark, raw, fresh):
    path = fresh("splits")
    prepare_dataset(raw, path)
    plan = tables.read_split(spark, path, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_split_is_the_same_for_any_partitioning(raw):
    a = rows(split_articles(raw.repartition(1)), "row_key", "split", "small")
    b = rows(split_articles(raw.repartition(16)), "row_key", "split", "small")
    assert sorted(a) == sorted(b)


def test_csv_round_trip(spark, fresh):
    data = [
        ('He said "no",\nthen left.', None, "x"),
        ("", "two\r\nlines", " padded "),
        ("back\\slash \\N", "comma, quote\"", "ünï ١"),
        ("\\", "'", "a\\\"b"),
    ]
    df = spark.createDataFrame(data, "a string, b string, c string").coalesce(1)
    path = fresh("csv")
    tables.write_articles_csv(df, path)
    back = tables.articles_csv(spark, path, ["a", "b", "c"])
    assert sorted(map(repr, rows(back))) == sorted(map(repr, data))


def test_csv_splits(spark, raw, fresh):
    path = fresh("csv-splits")
    tables.write_splits(split_articles(raw), path, as_csv=True)
    assert spark.read.option("header", True).option("multiLine", True).csv(path).count() == 5


def test_racing_calls_leave_one_whole_table(spark, fresh):
    from concurrent.futures import ThreadPoolExecutor

    path = fresh("raced")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: tables.write_if_absent(spark.range(k * 100, k * 100 + 100, 1, 3), path), range(4)))
    got = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert made.count(True) == 1
    assert got == list(range(made.index(True) * 100, made.index(True) * 100 + 100))
    assert [p.name for p in Path(path).parent.iterdir()] == ["raced"]  # nothing of the others is left


def test_write_if_absent_keeps_what_is_there(spark, fresh):
    path = fresh("once")
    tables.write_if_absent(spark.range(3), path)
    tables.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_documents_of_an_event(spark):
    data = [("e", i, None if i == 2 else f"text {i}") for i in range(1, 7)] + [("solo", 1, "alone"), ("none", 1, None)]
    df = spark.createDataFrame(data, "event string, id int, article string").repartition(5)
    got = {r["event"]: (r["document"], r["n_documents"]) for r in concat_documents(df, "event", "article", ["id"]).collect()}
    assert got["e"] == (C.DOCUMENT_SEPARATOR.join(f"text {i}" for i in (1, 3, 4, 5)), 4)
    assert got["solo"] == ("alone", 1)
    assert got["none"] == ("", 0)


def test_events_are_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id", "id % 2 as event", "cast(id as string) as article")
    plan = concat_documents(df, "event", "article", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    plain = concat_documents(df, "event", "article", ["id"], merge_groups=1)
    assert plain._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_an_event_with_most_of_the_rows(spark):
    df = spark.range(3000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as event", "concat('text ', id) as article"
    ).repartition(40)
    for groups in (1, 8):
        got = {r["event"]: r["document"] for r in concat_documents(df, "event", "article", ["id"], separator="|", merge_groups=groups).collect()}
        assert got["hot"] == "text 0|text 3|text 6|text 9|text 12"
        assert len(got) == 51
