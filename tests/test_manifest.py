"""Published slices: nothing of a dead run is seen, and nothing is done twice."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.operators import grid
from textfacts.plans.evaluation import evaluate_rows, run_evaluation
from textfacts.sources import manifest

MODELS = {name: C.MODELS[name] for name in ("T5-Base", "LED-ArXiv")}


@pytest.fixture()
def samples(spark):
    text = "one two three four five six seven eight nine ten " * 5
    return spark.createDataFrame([(k, f"{k} {text}", "one two three") for k in range(20)], "sample_id long, article string, summary string")


def pairs(spark, path):
    return sorted(rows(manifest.published_predictions(spark, path), "model_name", "sample_id"))


EVERY = sorted((m, k) for m in MODELS for k in range(20))


def test_a_run_that_dies_before_it_publishes(spark, samples, fresh, monkeypatch):
    path, calls = fresh("run"), []
    real = manifest.publish

    def dies(*args, **options):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt("the driver is gone")
        real(*args, **options)

    monkeypatch.setattr(manifest, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        run_evaluation(samples, path, MODELS, metrics=("rouge1",), commits=3, published=True)
    seen = pairs(spark, path)
    assert 0 < len(seen) < len(EVERY) and len(set(seen)) == len(seen)
    assert manifest.unpublished(spark, path).count() == 1
    monkeypatch.setattr(manifest, "publish", real)
    current = run_evaluation(samples, path, MODELS, metrics=("rouge1",), commits=2, published=True)
    assert pairs(spark, path) == EVERY and current.count() == len(EVERY)
    assert manifest.manifest(spark, path).count() == 3


def test_the_first_published_attempt_counts(spark, samples, fresh):
    path = fresh("run")
    todo = grid.expand_pending(grid.pending_models(samples, samples.select("sample_id").withColumn("model_name", F.lit("x")), "sample_id", MODELS))
    made = evaluate_rows(todo.withColumn("n_words", F.lit(5)), metrics=("rouge1",), stemmed=False)
    one = manifest.write_attempt(made.withColumn("run_id", F.lit("one")), path, "slice-0")
    two = manifest.write_attempt(made.withColumn("run_id", F.lit("two")), path, "slice-0")
    assert pairs(spark, path) == []
    manifest.publish(spark, path, "slice-0", two)
    manifest.publish(spark, path, "slice-0", one)
    assert pairs(spark, path) == EVERY
    assert rows(manifest.published_predictions(spark, path).select("run_id").distinct()) == [("two",)]


def test_nothing_published_yet(spark, fresh):
    assert pairs(spark, fresh("nothing")) == [] and rows(manifest.unpublished(spark, fresh("nothing"))) == []


def test_batches_by_length_keep_the_budget():
    sizes = [5, 900, 5, 6, 100, 100, 0, 2000]
    batches = grid.by_length(range(len(sizes)), sizes, 1000)
    assert sorted(r for b in batches for r in b) == list(range(len(sizes)))
    assert all(len(b) * max(sizes[r] for r in b) <= 1000 or len(b) == 1 for b in batches)
    assert len(batches) < len(grid.in_order(range(len(sizes)), 2))


def test_generated_rows_do_not_depend_on_the_batches(spark, samples):
    seen = spark.sparkContext.accumulator(0)

    def summarise(model_id):
        def run(texts):
            seen.add(1)
            return [t[:9] for t in texts]

        return run

    ready = grid.with_status(samples, "article", "summary").withColumn("model_id", F.lit("m")).withColumn("input_length", F.length("article"))
    plain, batched = (grid.generate(ready, summarise, token_budget=b).drop("duration_ms") for b in (None, 600))
    assert rows(plain) == rows(batched)


def test_padding_is_less_by_length(spark, folder):
    from textfacts.plans.catalog import QUERIES

    for r in QUERIES["batch_padding"](spark, folder).collect():
        assert r["overhead_by_length"] < r["overhead_in_order"]
