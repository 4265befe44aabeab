"""Every registered query against its DuckDB twin, and the plans of some."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare, connect  # noqa: E402
from oracle import ORACLES  # noqa: E402
from textfacts.plans.catalog import QUERIES  # noqa: E402
from textfacts.plans import views  # noqa: E402



@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, duck, folder, name):
    verdict, _, _, n = compare(spark, duck, folder, name)
    assert verdict == "equal"
    assert n > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize(
    "name, column",
    [("temporal_consistency", "temporal"), ("hallucinated_dates", "temporal_loss"), ("entity_consistency", "entity"),
     ("vocab_preservation", "entity_loss"), ("factuality_overall", "overall")],
)
def test_scores_differ_between_pairs(spark, folder, name, column):
    got = contract.queries()[name](spark, folder).toPandas()
    assert len(got) == 4 * spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got[column].nunique() >= 3
    assert got.groupby("system")[column].mean().nunique() == 4


def test_every_kind_of_date_is_found(spark, folder):
    found = "|".join(r["dates"] for r in contract.queries()["dates_full"](spark, folder).collect()).split("|")
    for pattern in (r"\d+/\d+/\d{4}", r"\d{4}", r"[A-Z][a-z]{2} \d+, \d{4}", r"\d+ [A-Z][a-z]{2} \d{4}"):
        assert sum(bool(re.fullmatch(pattern, d)) for d in found) >= 100


def test_systems_differ_in_every_metric(spark, folder):
    points = {r["metric"]: r["points"] for r in contract.queries()["system_delta"](spark, folder).collect()}
    assert len(points) == 3 and all(points.values())


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def plan(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["curate_split_positional", "split_orders_by_date", "sample_seeded", "word_counts", "encode_pad_mask", "eval_generate",
     "dates_full", "entity_mentions"],
)
def test_row_wise_work_never_meets_in_one_task(spark, folder, name):
    shown = plan(spark, folder, name)
    assert "SinglePartition" not in shown
    assert "Exchange" not in shown or name == "entity_mentions"  # which counts per document


@pytest.mark.parametrize("name", ["curate_articles", "curate_exact_dedup"])
def test_no_text_is_a_shuffle_key(spark, folder, name):
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan(spark, folder, name))
    assert keys and all(re.match(r"(_row|row_key)#", k) for k in keys)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, folder, name):
    if name.startswith(("write", "eval", "read", "scan_articles", "loss_history")):
        pytest.skip("runs jobs while it is built; its parts are covered by the other names")
    shown = plan(spark, folder, name)
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_scans_read_only_what_they_need(spark, folder):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, folder, "word_counts")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(spark, folder, "sample_seeded")


def test_pair_texts_are_put_together_once_a_document(spark, folder):
    plan = views.pairs(views.pair_documents(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    systems = next(k for k, line in enumerate(plan.splitlines()) if "Generate inline(array(struct(system" in line)
    lines = plan.splitlines()
    assert not any("array_join" in line for line in lines[: systems + 1]) and "array_join" in lines[systems + 1]
