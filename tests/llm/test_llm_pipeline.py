from pathlib import Path

import corpus_pipeline as pipeline
import pytest
from conftest import rows
from test_llm_decontaminate import slow_distance
from test_llm_near_copies import slow as slow_classes

from textfacts.llm import decontaminate, pieces
from textfacts.session import materialise


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], folder), name))
    return out


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "passages", "decontaminate", "pieces"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_clean_documents(steps):
    before, after = by_id(steps[0]), by_id(steps[1])
    assert set(after.items()) <= set(before.items()) and len(after) >= 0.98 * len(before)


def test_columns_named_like_the_verdict_stay(spark, folder, steps):
    docs = steps[0].limit(40).selectExpr("*", "doc_id as score", "'x' as lang_pred")
    kept = pipeline.language(spark, docs, folder)
    assert kept.columns == docs.columns
    assert all(r["score"] == r["doc_id"] and r["lang_pred"] == "x" for r in kept.collect())


def test_one_document_of_each_class(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    assert set(after) == {c for _, c, _, _ in slow_classes(list(before.items()))}


def test_repeats_go_and_rows_stay(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert set(before) == set(after)
    seen = set()
    for doc_id in sorted(before):
        raw = before[doc_id].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        assert after[doc_id] == bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert steps[3].where("n_chars != length(text)").count() == 0


def test_contaminated_documents_go(spark, folder, steps):
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = by_id(steps[3]), by_id(steps[4])
    for doc_id, text in before.items():
        if doc_id in after:
            assert not any(i in decontaminate.normal(text) for i in items)
        else:
            assert any(slow_distance(i, decontaminate.normal(text)) <= 0.05 * len(i) for i in items)


def test_ids_give_the_texts_back(steps):
    vocabulary = pieces.load_vocabulary()
    texts = by_id(steps[4])
    assert {r["doc_id"]: pieces.decode(r["ids"], vocabulary) for r in steps[5].collect()} == texts


def test_run_is_the_stages_one_after_the_other(spark, folder, steps):
    assert sorted(rows(pipeline.run(spark, folder)), key=repr) == sorted(rows(steps[-1]), key=repr)


def test_stages_on_an_empty_table_and_odd_rows(spark, folder, steps):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "only text here", None, "s", 14), (2, "", "en", "s", 0)], steps[0].schema)
    for _name, stage in pipeline.STAGES:
        assert stage(spark, steps[0].where("false"), folder).count() == 0
        assert stage(spark, odd, folder).count() <= 4


def test_pipeline_lies_at_the_top():
    assert Path(pipeline.__file__).parent == Path(__file__).resolve().parents[2]
