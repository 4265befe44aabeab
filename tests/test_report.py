import random

import pytest
from conftest import rows

from textfacts.operators import report as R
from textfacts.sources import results as res

# Published scores of ten models in rank order (name; ROUGE-1, -2, -L and their
# deviations; samples, successes, failures; success rate; seconds; hours).
PUBLISHED = [
    ("BART-Base", 46.16, 21.67, 29.92, 10.66, 10.87, 9.77, 200, 200, 0, 100.0, 15825.59, 4.4),
    ("BART-Large-CNN", 41.02, 21.54, 30.83, 13.36, 15.87, 14.61, 200, 200, 0, 100.0, 9587.64, 2.66),
    ("DistilBART", 42.05, 21.31, 30.32, 12.17, 13.49, 12.79, 200, 200, 0, 100.0, 3052.85, 0.85),
    ("LED-ArXiv", 44.97, 20.76, 29.21, 11.31, 10.97, 10.17, 200, 200, 0, 100.0, 5946.02, 1.65),
    ("T5-Large", 40.26, 18.95, 28.45, 9.8, 10.82, 10.37, 200, 200, 0, 100.0, 43501.38, 12.08),
    ("PEGASUS-CNN", 37.48, 17.72, 26.81, 10.26, 10.61, 10.6, 200, 200, 0, 100.0, 21900.08, 6.08),
    ("T5-Base", 38.11, 17.39, 27.08, 10.45, 10.92, 10.44, 200, 200, 0, 100.0, 3540.59, 0.98),
    ("LongT5-Base", 34.39, 14.43, 22.79, 10.72, 10.4, 9.94, 200, 200, 0, 100.0, 5663.54, 1.57),
    ("PEGASUS-XSum", 33.27, 13.39, 21.82, 9.81, 7.62, 8.0, 200, 123, 77, 61.5, 1559.33, 0.43),
    ("mT5-Base", 14.92, 4.38, 10.14, 8.07, 4.7, 5.12, 200, 200, 0, 100.0, 2744.22, 0.76),
]
KIND = (
    "model_name string, rouge1_mean double, rouge2_mean double, rougeL_mean double, rouge1_std double, "
    "rouge2_std double, rougeL_std double, total_samples long, successful_samples long, failed_samples long, "
    "success_rate double, seconds double, published_hours double"
)


@pytest.fixture(scope="module")
def scores(spark):
    shuffled = PUBLISHED[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, KIND).withColumn("time_hours", R.hours("seconds"))


def test_leaderboard_order_and_hours(scores):
    board = R.leaderboard(scores).orderBy("rank").collect()
    assert [r["model_name"] for r in board] == [p[0] for p in PUBLISHED]
    assert [r["rank"] for r in board] == list(range(1, 11))
    assert [r["time_hours"] for r in board] == [p[-1] for p in PUBLISHED]


def test_tiers_and_selection(scores):
    got = {r["model_name"]: (r["tier"], r["selected"]) for r in R.with_tier(R.leaderboard(scores)).collect()}
    assert got["BART-Base"] == ("GOLD", False)
    assert got["BART-Large-CNN"][0] == "SILVER" and got["DistilBART"][0] == "BRONZE"
    assert got["LED-ArXiv"] == ("", True)
    assert sum(flag for _, flag in got.values()) == 1


def test_best_differs_by_metric(scores):
    assert R.best_model(scores).first()["model_name"] == "BART-Base"
    assert R.best_model(scores, "rougeL_mean").first()["model_name"] == "BART-Large-CNN"
    assert [r["model_name"] for r in R.named_models(scores, "LED").collect()] == ["LED-ArXiv"]


def test_board_statistics(scores):
    row = R.board_statistics(scores).first()
    assert (row["n_models"], row["n_full_success"], row["n_successful"], row["n_failed"]) == (10, 9, 1923, 77)
    assert round(row["avg_rouge2"], 3) == 17.154
    assert round(row["total_hours"], 2) == 31.46


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "model_name string, rouge2_mean double")
    assert rows(R.leaderboard(df).orderBy("rank"), "model_name") == [("a",), ("b",)]
    assert R.best_model(df).first()["model_name"] == "a"


def test_change_against_published(spark):
    kind = "model_name string, rouge2 double"
    ours = spark.createDataFrame([("BART-Large-CNN", 21.54), ("PEGASUS-CNN", 17.72), ("T5-Large", 18.95)], kind)
    theirs = spark.createDataFrame([("BART-Large-CNN", 24.1), ("PEGASUS-CNN", 21.47), ("T5-Large", 21.0)], kind)
    got = {r["model_name"]: round(r["change_percent"], 1) for r in R.against_published(ours, theirs, "model_name", "rouge2").collect()}
    assert got == {"BART-Large-CNN": -10.6, "PEGASUS-CNN": -17.5, "T5-Large": -9.8}


def test_deviation_is_of_the_population(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.3)], "m string, rouge1 double")
    row = R.score_summary(df, "m", ["rouge1"]).first()
    assert row["rouge1_mean"] == pytest.approx(20.0) and row["rouge1_std"] == pytest.approx(10.0)


def test_missing_models(spark, scores):
    expected = spark.createDataFrame([("BART-Base",), ("GPT",)], "model_name string")
    assert rows(R.missing_models(expected, scores)) == [("GPT",)]


LOG = "stage string, epoch int, batch_idx long, computed boolean, ce double, entity double, temporal double, semantic double, total double"


def test_epoch_means_both_ways(spark):
    data = [("factuality", 1, i, i == 0, 1.0, 0.311 if i == 0 else 0.0, 0.0, 0.0, 1.0) for i in range(10)]
    data.append(("warmup", 1, 0, False, 2.0, 0.0, 0.0, 0.0, 2.0))
    log = spark.createDataFrame(data, LOG)
    filled = {r["stage"]: r for r in R.epoch_means(log).collect()}
    only = {r["stage"]: r for r in R.epoch_means(log, mode="computed_only").collect()}
    assert filled["factuality"]["entity_mean"] == pytest.approx(0.0311)
    assert only["factuality"]["entity_mean"] == pytest.approx(0.311)
    assert only["warmup"]["entity_mean"] is None and only["warmup"]["ce_mean"] == 2.0
    with pytest.raises(ValueError):
        R.epoch_means(log, mode="other")


def test_loss_is_due(spark):
    df = spark.createDataFrame([(0, "warmup"), (0, "factuality"), (5, "factuality"), (20, "refinement")], "b long, s string").coalesce(1)
    assert [r[0] for r in rows(df.select(R.loss_is_due("b", "s")))] == [False, True, False, True]


def test_latest_checkpoint_by_number(spark):
    df = spark.createDataFrame(
        [("a", "out/checkpoint-900"), ("a", "out/checkpoint-1000"), ("a", "out/final"), ("b", "x")], "run string, path string"
    )
    assert rows(R.latest_checkpoint(df, "path", ["run"])) == [("a", "out/checkpoint-1000", 1000)]
    assert rows(R.latest_checkpoint(df, "path")) == [("out/checkpoint-1000", 1000)]


def test_system_comparison(spark):
    df = spark.createDataFrame([("base", 0.3), ("base", 0.3), ("new", 0.0), ("other", 1.0)], "system string, loss double")
    row = R.system_comparison(df, "system", {"entity": "loss"}, "base", "new").first()
    assert row["metric"] == "entity"
    assert [row["baseline"], row["proposed"], row["points"]] == [pytest.approx(x) for x in (70.0, 100.0, 30.0)]


def test_leaderboard_files(spark, scores, fresh):
    path = fresh("board")
    res.write_leaderboard(R.leaderboard(scores), path, ["rank", "model_name", "rouge2_mean"])
    short = spark.read.option("header", True).csv(f"{path}/summary_csv")
    assert short.columns == ["rank", "model_name", "rouge2_mean"] and short.count() == 10
    assert spark.read.json(f"{path}/leaderboard_json").count() == 10
    assert spark.read.option("header", True).csv(f"{path}/leaderboard_csv").first()["model_name"] == "BART-Base"


def test_loss_history(spark, fresh):
    path = fresh("losses")
    for stage in ("warmup", "factuality"):
        log = spark.createDataFrame([(stage, 1, 0, False, 1.0, 0.0, 0.0, 0.0, 1.0)], LOG)
        res.append_losses(log, path)
    assert sorted(rows(res.read_losses(spark, path), "stage", "ce")) == [("factuality", 1.0), ("warmup", 1.0)]
