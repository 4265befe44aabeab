import pytest
from conftest import rows

from textfacts import constants as C
from textfacts.functions import text as T
from textfacts.operators import grid
from textfacts.operators.report import run_aggregates
from textfacts.plans.evaluation import evaluation_scores, event_samples, run_evaluation
from textfacts.sources import results as res

MODELS = {"BART-Base": "facebook/bart-base", "T5-Base": "t5-base"}


@pytest.fixture(scope="module")
def samples(spark):
    text = " ".join(f"word{i}" for i in range(60))
    data = [(i, f"{text} end{i}", f"{text}") for i in range(8)] + [(8, None, "r"), (9, text, ""), (10, "boom", "r")]
    return spark.createDataFrame(data, "sample_id long, article string, summary string").repartition(3)


@pytest.fixture()
def fragile():
    def first_ten_words(model_id, text):
        if "boom" in text:
            raise RuntimeError("no summary for this")
        return " ".join(text.split()[:10])

    return grid.per_text(first_ten_words)


def test_articles_are_split_once_for_all_models(spark, fresh, monkeypatch):
    texts = ["", "one", " lead\t and\u2003more ", None, *(" ".join(f"w{i}" for i in range(n)) for n in (39, 119, 120, 122, 448, 449, 450, 451, 900))]
    samples = spark.createDataFrame([(i, t, "w1 w2") for i, t in enumerate(texts)], "sample_id long, article string, summary string")
    prompted = grid.expand_pending(grid.pending_models(samples, samples.sparkSession.createDataFrame([], "model_name string, sample_id long"), "sample_id", MODELS))
    whole = prompted.select("model_name", "sample_id", grid.lead_summary(T.with_prompt("article", "model_id")).alias("s")).where("article <> ''")
    want = {(m, i): s for m, i, s in rows(whole)}
    monkeypatch.setattr(grid, "lead_summary", None)  # would split every article for every model
    for commits in (1, 2):
        got = run_evaluation(samples, fresh(f"p{commits}"), MODELS, metrics=("rouge1",), commits=commits)
        assert {(r["model_name"], r["sample_id"]): r["generated_summary"] for r in got.where("status = 'ok'").collect()} == want
        long = got.where("sample_id = 4").collect()
        assert {(r["model_name"], r["input_length"]) for r in long} == {("BART-Base", 39), ("T5-Base", 40)}


def test_pending_grid(spark, samples):
    done = spark.createDataFrame([("BART-Base", 1), ("T5-Base", 1), ("T5-Base", 2), ("Other", 3)], "model_name string, sample_id long")
    got = rows(grid.pending_grid(samples, done, "sample_id", MODELS), "model_name", "sample_id")
    want = {(m, i) for m in MODELS for i in range(11)} - {("BART-Base", 1), ("T5-Base", 1), ("T5-Base", 2)}
    assert len(got) == len(want) and set(got) == want


def test_samples_shuffle_once_for_all_models(spark, samples):
    done = spark.range(5).selectExpr("id as sample_id", "'T5-Base' as model_name")
    plan = grid.pending_grid(samples, done, "sample_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the models come in above the join


def test_status(samples):
    got = dict(rows(grid.with_status(samples, "article", "summary"), "sample_id", "error"))
    assert got[8] == "empty article" and got[9] == "empty reference" and got[0] is None


def test_a_failing_row_does_not_stop_the_run(samples, fresh, fragile):
    done = run_evaluation(samples, fresh("p"), MODELS, fragile)
    by_row = {(r["model_name"], r["sample_id"]): r for r in done.collect()}
    assert len(by_row) == 22
    assert by_row["T5-Base", 10]["error"] == "RuntimeError: no summary for this"
    assert by_row["T5-Base", 10]["rouge1"] is None
    assert by_row["T5-Base", 0]["generated_summary"].startswith("summarize: word0")
    assert by_row["T5-Base", 0]["article_preview"].endswith("...")
    assert by_row["BART-Base", 0]["rouge1"] == pytest.approx(2 * (10 / 60) / (1 + 10 / 60))
    assert by_row["BART-Base", 0]["duration_ms"] >= 0 and by_row["BART-Base", 8]["duration_ms"] is None
    score = {r["model_name"]: r for r in evaluation_scores(done).collect()}["BART-Base"]
    assert (score["total_samples"], score["successful_samples"], score["failed_samples"]) == (11, 8, 3)
    assert score["success_rate"] == 72.73
    assert score["avg_input_length"] == 61.0


def test_a_model_loads_once_per_task_and_batches_are_retried_by_row(spark, samples, fresh):
    log = fresh("log")
    open(log, "w").close()

    def load(model_id):
        with open(log, "a") as out:
            out.write(f"load {model_id}\n")
        if model_id == "t5-base":
            raise OSError("no such model")

        def summarise(texts):
            with open(log, "a") as out:
                out.write(f"batch {len(texts)}\n")
            if any("boom" in t for t in texts):
                raise RuntimeError("no summary for this")
            return [t.split()[0] for t in texts]

        return summarise

    done = run_evaluation(samples.coalesce(1), fresh("p"), MODELS, load)
    by_row = {(r["model_name"], r["sample_id"]): r for r in done.collect()}
    assert {by_row["T5-Base", i]["error"] for i in range(8)} == {"model not loaded: OSError: no such model"}
    assert by_row["BART-Base", 10]["error"] == "RuntimeError: no summary for this"
    assert all(by_row["BART-Base", i]["generated_summary"] == "word0" for i in range(8))
    told = open(log).read().split("\n")
    tasks = told.count("load facebook/bart-base")
    assert told.count("load t5-base") <= tasks + 1
    assert told.count("batch 1") == 9 and tasks <= 4  # the batch that failed, row by row


def test_commits_read_the_samples_once(spark, samples, fresh):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    counted = samples.mapInPandas(counting, samples.schema)
    run_evaluation(counted, fresh("p"), MODELS, commits=4, metrics=("rouge1",), stemmed=False)
    assert read.value == 11


def test_event_samples(spark):
    data = [(i, f"e{i % 2}", f"text {i}" if i != 4 else None, f"sum {i}") for i in range(14)]
    docs = spark.createDataFrame(data, "id long, event string, article string, summary string").repartition(3)
    got = {r["sample_id"]: (r["article"], r["summary"]) for r in event_samples(docs, "event", "article", ["id"], "summary").collect()}
    mark = C.DOCUMENT_SEPARATOR
    assert got == {"e0": (mark.join(f"text {i}" for i in (0, 2, 6, 8)), "sum 0"), "e1": (mark.join(f"text {i}" for i in (1, 3, 5, 7, 9)), "sum 1")}


def test_untimed_runs_have_no_seconds(spark, samples, fresh):
    score = run_aggregates(run_evaluation(samples, fresh("p"), MODELS, metrics=("rouge1",)), ("rouge1",)).first()
    assert score["evaluation_time_seconds"] is None and score["time_per_sample"] is None
    assert len(score["evaluation_date"]) == 10


def test_score_rows_of_one_file_all_come_back(spark, fresh):
    rows_ = [("a/b", 1), ("c", 2), ("c", 3)]
    scores = spark.createDataFrame(rows_, "model_name string, total_samples long").coalesce(1)
    path = fresh("s")
    res.write_scores(scores, path)
    assert sorted(rows(res.read_scores(spark, path), "model_name", "total_samples")) == rows_
    clash = spark.createDataFrame([("a-b", 1), ("a/b", 2)], "model_name string, total_samples long")
    with pytest.raises(ValueError, match="a-b, a/b"):
        res.write_scores(clash, fresh("t"))


def test_a_second_run_adds_nothing(spark, samples, fresh):
    path = fresh("p")
    run_evaluation(samples, path, MODELS)
    first = res.all_predictions(spark, path).count()
    run_evaluation(samples, path, MODELS)
    assert res.all_predictions(spark, path).count() == first == 22


def test_resume_does_only_what_is_left(spark, samples, fresh):
    path = fresh("p")
    run_evaluation(samples.where("sample_id < 4"), path, {"T5-Base": "t5-base"})
    run_evaluation(samples, path, MODELS, commits=3)
    table = res.all_predictions(spark, path)
    assert table.count() == 22
    assert table.select("run_id").distinct().count() == 2
    assert res.model_predictions(spark, path, "T5-Base").count() == 11


def test_failed_rows_can_be_retried(spark, samples, fresh, fragile):
    path = fresh("p")
    run_evaluation(samples, path, MODELS, fragile)
    current = run_evaluation(samples, path, MODELS, grid.per_text(lambda m, t: "fine now"), retry_failed=True)
    again = {(r["model_name"], r["sample_id"]): r["status"] for r in current.collect()}
    assert len(again) == 22
    assert again["BART-Base", 10] == "ok" and again["BART-Base", 8] == "failed"
    assert res.all_predictions(spark, path).count() == 28


def test_starting_over(samples, fresh):
    path = fresh("p")
    run_evaluation(samples, path, MODELS, grid.per_text(lambda m, t: "old"))
    current = run_evaluation(samples, path, MODELS, grid.per_text(lambda m, t: "new"), resume=False)
    made = {r["generated_summary"] for r in current.where("status = 'ok'").collect()}
    assert current.count() == 22 and made == {"new"}


def test_merge_prefers_earlier_rows(spark):
    kind = "model_name string, sample_id long, origin string"
    earlier = spark.createDataFrame([("a", 1, "old")], kind)
    new = spark.createDataFrame([("a", 1, "new"), ("a", 2, "new"), ("b", 1, "new")], kind)
    assert sorted(rows(grid.merge_results(earlier, new))) == [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "new")]


@pytest.mark.parametrize("n, kept", [(10, 10), (100, 40), (300, 100), (1000, 150)])
def test_lead_summary_length(spark, n, kept):
    df = spark.createDataFrame([(" ".join(["w"] * n),)], "t string")
    assert len(df.select(grid.lead_summary("t").alias("s")).first()["s"].split()) == kept


def test_score_files_and_run_summary(spark, samples, fresh):
    scores = evaluation_scores(run_evaluation(samples, fresh("p"), MODELS))
    path = fresh("scores")
    res.write_scores(scores, path)
    back = res.read_scores(spark, path)
    assert dict(rows(back, "model_name", "folder")) == {"BART-Base": "bart_base", "T5-Base": "t5_base"}
    assert res.model_scores(spark, path, "T5-Base").first()["total_samples"] == 11
    failed = spark.createDataFrame([("mT5-Base",)], "model_name string")
    summary = res.run_summary(scores, failed, "2025-01-01", "someone", C.TEST_ROWS).first()
    assert summary["experiment_metadata"]["num_models_evaluated"] == 2
    assert summary["failed_models"] == ["mT5-Base"]
    assert [r["model_name"] for r in summary["results"]] == ["BART-Base", "T5-Base"]


def test_score_files_laid_out_by_hand(spark, tmp_path):
    for folder, name in (("bart_base", "BART-Base"), ("t5_large", "T5-Large")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "aggregate_scores.json").write_text(
            '{\n  "model_name": "%s",\n  "total_samples": 200,\n  "rouge2_mean": 21.5\n}' % name
        )
        (tmp_path / folder / "scores.json").write_text('{"model_name": "other"}')
    got = res.read_scores(spark, str(tmp_path), "aggregate_scores.json")
    assert sorted(rows(got, "folder", "model_name", "total_samples", "rouge2_mean")) == [
        ("bart_base", "BART-Base", 200, 21.5), ("t5_large", "T5-Large", 200, 21.5),
    ]


def test_missing_tables_are_empty(spark, fresh):
    assert res.all_predictions(spark, fresh("none")).count() == 0
    assert res.read_scores(spark, fresh("none")).count() == 0
    assert res.read_losses(spark, fresh("none")).count() == 0


def test_text_ids(spark, samples, fresh):
    path = fresh("p")
    keyed = samples.withColumn("sample_id", samples.sample_id.cast("string"))
    run_evaluation(keyed.where("sample_id < '5'"), path, MODELS)
    assert run_evaluation(keyed, path, MODELS).select("sample_id").distinct().count() == 11
    assert res.all_predictions(spark, path, "string").count() == 22
