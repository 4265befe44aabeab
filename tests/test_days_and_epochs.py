"""Statistics that merge by day, and epochs shuffled by place."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts.operators import ordering, sketches
from textfacts.sources.tables import scan


@pytest.fixture(scope="module")
def articles(spark):
    r = random.Random(4)
    made = [(f"2020-01-{d:02d}", r.randint(50, 900) if r.random() > 0.02 else None, r.randint(50, 250), f"headline {r.randint(0, 700)}", r.choice("abc")) for d in range(1, 21) for _ in range(100)]
    return spark.createDataFrame(made, "date string, article_word_count int, summary_word_count int, headline string, category string")


def close(spark, told, exact):
    row, data = told.first(), exact.toPandas()
    words = data["article_word_count"].dropna()
    assert row["n"] == len(data)
    assert row["avg_article_word_count"] == pytest.approx(words.mean())
    assert row["std_article_word_count"] == pytest.approx(words.std(ddof=0))
    for q in (10, 50, 90):
        at = row[f"q{q}_article_word_count"]
        assert (words < at).mean() - 0.02 <= q / 100 <= (words <= at).mean() + 0.02
    assert abs(row["different_headline"] - data["headline"].nunique()) <= 0.05 * data["headline"].nunique() + 1
    assert row["different_category"] == data["category"].nunique()


def test_days_are_added_without_the_old_ones(spark, articles, fresh):
    path = fresh("days")
    for low, high in ((1, 5), (6, 6), (7, 20)):
        part = articles.where(F.col("date").between(f"2020-01-{low:02d}", f"2020-01-{high:02d}"))
        sketches.store_days(sketches.day_sketches(part), path)
    close(spark, sketches.day_statistics(sketches.read_days(spark, path)), articles)
    some = articles.where("date between '2020-01-04' and '2020-01-09'")
    close(spark, sketches.day_statistics(sketches.read_days(spark, path, "2020-01-04", "2020-01-09")), some)


def test_a_day_stored_again_counts_once(spark, articles, fresh):
    path = fresh("days")
    sketches.store_days(sketches.day_sketches(articles), path)
    sketches.store_days(sketches.day_sketches(articles.where("date = '2020-01-03'")), path)
    assert sketches.day_statistics(sketches.read_days(spark, path)).first()["n"] == 2000


def test_no_days(spark, articles):
    row = sketches.day_statistics(sketches.day_sketches(articles.where("false"))).first()
    assert row["avg_article_word_count"] is None and row["q50_article_word_count"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256, 1000])
@pytest.mark.parametrize("epoch", [0, 7])
def test_every_epoch_is_a_permutation(spark, n, epoch):
    made = spark.range(n).select("id", ordering.shuffled_place("id", n, epoch).alias("place"))
    back = made.select("id", "place", ordering.position_at("place", n, epoch).alias("back"))
    got = rows(back)
    assert sorted(p for _, p, _ in got) == list(range(n)) and all(i == b for i, _, b in got)


def test_places_look_shuffled(spark):
    n = 2000
    places = [[p for _, p in sorted(rows(spark.range(n).select("id", ordering.shuffled_place("id", n, e))))] for e in (0, 1)]
    assert sum(a == b for a, b in zip(*places, strict=True)) < 10
    for of in places:
        assert sum(abs(a - b) == 1 for a, b in zip(of, of[1:])) < 15
        assert abs(sum(of[: n // 2]) / (n // 2) - n / 2) < 60  # about 4 standard errors


def test_positions_do_not_depend_on_splits(spark, fresh):
    path = fresh("files")
    spark.range(5000).repartition(7).write.option("parquet.block.size", 4096).parquet(path)
    found = []
    for size in ("1g", "3k"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(dict(rows(ordering.dense_positions(spark.read.parquet(path)), "id", "position")))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and sorted(found[0].values()) == list(range(5000))


def test_an_epoch_goes_on_at_any_batch(spark, folder):
    placed = ordering.dense_positions(scan(spark, folder, "documents").select("doc_id"))
    n = placed.count()
    whole = {}
    for doc, place, batch in rows(ordering.epoch_batches(placed, n, 3, 16), "doc_id", "place", "batch"):
        whole.setdefault(batch, []).append((place, doc))
    rest = rows(ordering.epoch_batches(placed, n, 3, 16, first=5), "doc_id")
    assert sorted(d for (d,) in rest) == sorted(d for b, of in whole.items() if b >= 5 for _, d in of)
    for batch in (0, 5, max(whole)):
        assert [d for (d,) in rows(ordering.epoch_batch(placed, n, 3, 16, batch), "doc_id")] == [d for _, d in sorted(whole[batch])]


def test_no_sort_of_the_epoch(spark, folder):
    placed = ordering.dense_positions(scan(spark, folder, "documents").select("doc_id"))
    shown = ordering.epoch_batches(placed, 1000, 0, 16)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in shown and "hashpartitioning(position" not in shown and "SortMergeJoin" not in shown
