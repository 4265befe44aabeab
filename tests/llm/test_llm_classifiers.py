import pickle

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfacts.llm import language, quality, toxicity
from textfacts.llm.common import sample_per_class, squared_hinge

ODD = [(1, None), (2, ""), (3, "12 -- !!"), (4, "x"), (None, "und der nicht"), (6, "lang " * 40_000), (6, "lang " * 40_000)]


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("clash"), "lang_pred": F.lit(0), "predicted": F.lit("a")}).repartition(2)


def rank_sum(score, label):
    """Chance that a row with label 1 scores above one with label 0."""
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    ones = (label == 1).sum()
    return (order[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_language_on_held_out_documents(spark, larger):
    got = language.op5_language(spark, larger).toPandas()
    known = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(known, on="doc_id")
    assert len(got) == len(known) and len(held) > 150
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_close_languages_are_told_apart_inside_their_family(spark):
    draw = np.random.default_rng(1)
    stock = {"en": ["the", "house", "with"], "de": ["das", "haus", "mit"], "nl": ["het", "huis", "met"], "fr": ["la", "maison", "avec"], "xx": ["qoq", "zyz", "wuw"]}
    data = [(i, " ".join(draw.choice(stock[k], 8)), k) for i, k in enumerate([*stock] * 40)]
    model = language.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.families == ["germanic", "romance", "xx"] and len(model.pairs) == 3
    told, score = language.classify(model, [" ".join(w) for w in stock.values()])
    assert told == list(stock) and (score > 0.4).all()


def test_language_of_odd_texts(spark, larger):
    docs = odd(spark)
    model = language.learn_held_out(spark.read.parquet(f"{larger}/documents.parquet"))
    got = language.predict(docs, model)
    assert got.columns == ["doc_id", "text", "predicted", "lang_pred", "score"]
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0)
    assert told[4][0] != "und" and told[6][0] != "und" and told[None][0] == "de" and got.count() == len(ODD)
    assert language.predict(docs.where("false"), model).count() == 0


def test_numerals_are_no_letters(spark, larger):
    model = language.learn_held_out(spark.read.parquet(f"{larger}/documents.parquet"))
    texts = ["½", "①", "²", "Ⅷ", "12 ③", "١"]
    found, scores = language.classify(model, texts)
    assert found == ["und"] * len(texts) and not scores.any()


def test_language_without_anything_to_learn(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.learn(none) is None
    assert rows(language.predict(none, None), "doc_id", "lang_pred", "score") == [(1, "und", 0.0)]


def test_squared_hinge_separates():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((400, 5)).astype(np.float32)
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 > 0, 1, -1).astype(np.float32)
    w = squared_hinge(x, y, 1e-3)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_sample_is_bounded_and_repeatable(spark):
    data = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    one = sorted(rows(sample_per_class(data, "toxic", 50)))
    assert len(one) == 100 and one == sorted(rows(sample_per_class(data.repartition(7), "toxic", 50)))


def test_quality_on_held_out_documents(spark, larger):
    got = quality.op2_quality(spark, larger).toPandas()
    labels = spark.read.parquet(f"{larger}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and len(held) > 80
    assert rank_sum(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_bradley_terry_is_the_least_loss():
    draw = np.random.default_rng(2)
    better, worse = draw.standard_normal((300, 3)) + [0.8, -0.3, 0], draw.standard_normal((300, 3))

    def loss(w):
        return np.log1p(np.exp(-(better - worse) @ w)).mean() + 1e-3 * w @ w

    w = quality.bradley_terry(better, worse)
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in 0.02 * draw.standard_normal((50, 3)))


def test_threshold_is_the_quantile_of_the_bad_share():
    draw = np.random.default_rng(3)
    good = np.arange(1000) % 5 != 0
    x = draw.standard_normal((1000, 2)) + good[:, None]
    ranking = quality.rank(x, good, 0.2)
    assert 0.19 < (ranking.score(x) < 0.5).mean() < 0.21


def test_quality_of_odd_texts(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (4, None), (3, 7)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels))
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(ODD)
    assert got.where("score between 0 and 1").count() == len(ODD)
    assert quality.learn(docs, labels.where("quality = 1")) is None
    assert quality.score(docs, None).where("score = 0.5 and predicted = 1").count() == len(ODD)
    assert quality.learn(docs.where("false"), labels) is None


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 10_000
    assert rank_sum(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert (held.predicted[held.toxic == 0] == 0).mean() > 0.97
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.8
    toxic = got[got.predicted == 1].evidence
    assert all(len(e) and all(x["cosine"] <= 1 + 1e-9 for x in e) for e in toxic)


def test_block_max_search_is_exact():
    draw = np.random.default_rng(0)

    def vector():
        terms = draw.choice(60, draw.integers(1, 12), replace=False)
        weights = draw.random(len(terms)) + 0.1
        return dict(zip(terms.tolist(), (weights / np.sqrt((weights**2).sum())).tolist(), strict=True))

    vectors = [vector() for _ in range(500)]
    vectors[7] = vectors[9] = vectors[400]
    ids = draw.permutation(500).tolist()
    index = toxicity.BlockMaxIndex(vectors, ids, 60)
    dense = np.zeros((500, 60))
    for row, v in zip(dense, vectors, strict=True):
        row[list(v)] = list(v.values())
    for query in [vectors[7], *(vector() for _ in range(60))]:
        cosine = np.round(dense[:, list(query)] @ list(query.values()), 12)
        want = [ids[i] for i in np.lexsort((ids, -cosine)) if cosine[i] > 0 and ids[i] != ids[3]][:15]
        for found in (index, pickle.loads(pickle.dumps(index))):
            assert [int(found.ids[p]) for p, _ in found.nearest(query, 15, without=ids[3])] == want


def test_index_without_dense_terms():
    index = toxicity.BlockMaxIndex([{0: 1.0}, {1: 1.0}], [5, 6], 2)
    assert not len(index.dense) and pickle.loads(pickle.dumps(index)).nearest({1: 1.0}, 3) == index.nearest({1: 1.0}, 3)


@given(st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" _aA9\n\u0130\u03a3\u0663\u00b2\u2014\u0301\U00010400\U0001f600"))))
def test_words_cut_on_bytes_are_those_of_the_pattern(texts):
    words, of_each = toxicity.words_of_each(texts)
    wanted = [toxicity._WORD.findall((t or "").lower()) for t in texts]
    assert words.to_pylist() == [w for text in wanted for w in text]
    assert of_each.tolist() == list(map(len, wanted))


def test_queries_beyond_one_turn_find_the_same():
    rng = np.random.default_rng(3)
    vectors = [{int(t): float(w) for t, w in zip(rng.choice(40, 5, replace=False), rng.random(5) + 0.1)} for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors[:300], list(range(300)), 40)
    queries = [toxicity._pair(v) for v in vectors]
    assert index.nearest_of_each(queries, 5, [None] * 700) == [index.nearest(v, 5) for v in vectors]


@given(st.lists(st.one_of(st.none(), st.text("abé日_1 ^.", max_size=30)), max_size=5), st.sets(st.text("abé日_1", min_size=1, max_size=7), max_size=8), st.sets(st.text("abé日_1", min_size=1, max_size=6), max_size=8))
def test_numbered_terms_are_the_counted_ones(texts, words, starts):
    vocabulary = {t: i for i, t in enumerate(sorted(words | {f"^{s}" for s in starts}))}
    got = toxicity.Numbered(vocabulary)(texts)
    want = [toxicity.term_counts(t, vocabulary) for t in texts]
    assert [dict(zip(a.tolist(), n.tolist(), strict=True)) for a, n in got] == [{vocabulary[t]: n for t, n in w.items()} for w in want]
    assert all((np.diff(a) > 0).all() for a, _ in got)


def test_document_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(i, "idiot here" if i % 3 == 0 else "Idiots") for i in range(30)], "doc_id long, text string").repartition(4)
    terms = {"idiot": 0, "^idio": 1, "here": 2}
    count, seen = toxicity.document_frequencies(docs, terms)
    assert count == 30 and seen.tolist() == [10, 30, 10]


def test_toxicity_of_odd_texts(spark):
    bad = [(100 + i, f"you are an idiot and a clown number {i}", 1) for i in range(60)]
    fine = [(200 + i, f"this is a nice day number {i}", 0) for i in range(60)]
    learned = spark.createDataFrame(bad + fine, "doc_id long, text string, toxic int")
    docs = odd(spark).select("doc_id", "text").unionByName(learned.select("doc_id", "text"))
    model = toxicity.learn(docs, learned.select("doc_id", "toxic"))
    assert set(model.terms) == {f"{mark}{w}" for w in ("you", "are", "an", "and", "idiot", "clown") for mark in ("", "^")} | {"^idio", "^clow"}
    told = {r["doc_id"]: r for r in toxicity.score(odd(spark), model).collect()}
    assert all(r["predicted"] == 0 and not r["evidence"] for r in told.values())
    told = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(told[d]["predicted"] == t and d not in [e["doc_id"] for e in told[d]["evidence"]] for d, _, t in bad + fine)
    only = toxicity.learn(docs, learned.where("toxic = 0").select("doc_id", "toxic"))
    assert {r["score"] for r in toxicity.score(docs, only).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_by_rare_words(spark):
    stock = [f"wort{i:04d}" for i in range(3000)]
    draw = np.random.default_rng(8)
    data = [(i, " ".join(draw.choice(stock, 40)), int(i % 4 == 0)) for i in range(200)]
    data[0] = (0, "ein seltenes schimpfwort steht nur hier", 1)
    learned = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    docs = learned.select("doc_id", "text").unionByName(spark.createDataFrame([(1000, data[0][1]), (1001, "eine schimpfwoertliche rede")], "doc_id long, text string"))
    model = toxicity.learn(docs, learned.select("doc_id", "toxic"))
    told = {r["doc_id"]: r for r in toxicity.score(docs, model).where("doc_id >= 1000").collect()}
    copy = told[1000].evidence[0]
    assert (copy["doc_id"], copy["toxic"]) == (0, 1) and abs(copy["cosine"] - 1) < 1e-9
    assert told[1000].score > told[1001].score and [e["doc_id"] for e in told[1001].evidence] == [0]


def test_commonest_word_may_stand_anywhere():
    at = quality.NAMES.index("commonest word")
    assert quality.measure("a spam spam spam b c d e f")[at] == 3 / 9
    assert quality.measure(None)[at] == 0
