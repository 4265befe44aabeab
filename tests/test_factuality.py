import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import factuality as fact
from textfacts.functions import text as T
from textfacts.functions.vectors import cosine
from textfacts.operators.factuality import loss_parts, staged_losses, terms_by_category


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expression.alias("x")).first()["x"]


SOURCE = "The harbour at Lind was opened to larger ships on May 12, 2020, after a long winter."


def temporal(spark, summary, source=SOURCE):
    score = fact.temporal_consistency(T.date_mentions("s"), T.date_mentions("r"))
    return one(spark, score, s=summary, r=source)


def test_temporal_consistency_examples(spark):
    assert temporal(spark, "Lind opened its harbour on May 12, 2020.") == 1.0
    assert temporal(spark, "Lind opened its harbour on June 15, 2020.") == 0.5
    assert temporal(spark, "No date at all.") == 1.0
    assert temporal(spark, "In 1999.", "Nothing.") == 0.0


def test_invented_date_loss_is_the_complement(spark):
    for summary in ("May 12, 2020", "June 15, 2020", "1999 and 2020", ""):
        dates = T.date_mentions("s", year=T.WORD_YEAR), T.date_mentions("r", year=T.WORD_YEAR)
        kept = one(spark, fact.temporal_consistency(*dates), s=summary, r=SOURCE)
        lost = one(spark, fact.invented_date_loss(*dates), s=summary, r=SOURCE)
        assert kept + lost == 1.0


VOCAB_SOURCE = "Two crore for the new IAS school was voted by the Lok Sabha."


@pytest.mark.parametrize(
    "summary, loss",
    [
        ("The Lok Sabha voted two crore for an IAS school.", 0.0),
        ("Money for a school was voted.", 0.75),
        ("", 1.0),
    ],
)
def test_term_loss_examples(spark, summary, loss):
    got = fact.term_loss(T.vocabulary_terms("s"), T.vocabulary_terms("r"))
    assert one(spark, got, s=summary, r=VOCAB_SOURCE) == loss


def test_term_loss_without_source_terms(spark):
    assert one(spark, fact.term_loss(T.vocabulary_terms("s"), T.vocabulary_terms("r")), s="crore", r="x") == 0.0


def mentions(*pairs):
    items = [F.struct(F.lit(k).alias("type"), F.lit(v).alias("text")) for k, v in pairs]
    return F.array(*items) if items else F.array().cast("array<struct<type:string,text:string>>")


@pytest.mark.parametrize(
    "ours, theirs, score",
    [
        ([], [("ORG", "RBI")], 1.0),
        ([("ORG", "RBI")], [("ORG", "RBI")], 1.0),
        ([("ORG", "rbi")], [("ORG", "RBI")], 0.5),
        ([("ORG", "Rao")], [("PERSON", "Asha Rao")], 0.0),
        ([("PERSON", "Rao")], [("PERSON", "Asha Rao")], 0.5),
        ([("PERSON", "Asha Rao")], [("PERSON", "Rao")], 0.0),
        ([("ORG", "RBI"), ("ORG", "RBI"), ("GPE", "Delhi")], [("ORG", "RBI")], 2 / 3),
    ],
)
def test_entity_consistency(spark, ours, theirs, score):
    got = spark.range(1).select(fact.entity_consistency(mentions(*ours), mentions(*theirs)).alias("x")).first()["x"]
    assert got == pytest.approx(score)


def test_overall_weights(spark):
    assert one(spark, fact.overall("e", "t", "s"), e=1.0, t=0.5, s=0.2) == pytest.approx(0.61)
    with pytest.raises(ValueError):
        fact.overall("e", "t", "s", {"entity": 0.5, "temporal": 0.5, "semantic": 0.5})


def test_semantic_loss_and_flag(spark):
    assert one(spark, fact.semantic_loss("s"), s=-1.0) == 2.0
    assert one(spark, fact.semantic_loss(F.lit(None).cast("double")), s=0) == 0.0
    assert one(spark, fact.semantic_loss(F.lit(None).cast("double"), missing_as_zero=False), s=0) is None
    assert one(spark, fact.semantic_flag("s"), s=C.SEMANTIC_THRESHOLD) is True


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0]),
         ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([None, 1.0], [1.0, 1.0]), ([], [])],
        "a array<float>, b array<float>",
    ).coalesce(1)
    got = [r["c"] for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert got == [pytest.approx(1.0), 0.0, pytest.approx(-1.0), 0.0, None, None, None, 0.0]


def test_stages_leave_out_parts_of_weight_zero(spark):
    for stage, weights in C.STAGE_WEIGHTS.items():
        shown = str(fact.staged_total(stage))
        for part, weight in weights.items():
            assert (part in shown) == bool(weight)


def test_staged_losses(spark):
    parts = spark.createDataFrame([(2.0, 0.5, 1.0, 0.25)], "ce double, entity double, temporal double, semantic double")
    got = {r["stage"]: r["total"] for r in staged_losses(parts).collect()}
    assert got == {"warmup": 2.0, "factuality": pytest.approx(1.35), "refinement": pytest.approx(1.15)}


def test_loss_parts_with_missing_similarity(spark):
    df = spark.range(1).select(
        T.vocabulary_terms(F.lit(VOCAB_SOURCE)).alias("source_terms"),
        T.vocabulary_terms(F.lit("crore")).alias("summary_terms"),
        T.date_mentions(F.lit("2020")).alias("summary_date_words"),
        T.date_mentions(F.lit("2021")).alias("source_date_words"),
        F.lit(None).cast("double").alias("similarity"),
    )
    row = loss_parts(df, "similarity").first()
    assert (row["entity"], row["temporal"], row["semantic"]) == (0.75, 1.0, 0.0)


def test_terms_by_category(spark):
    df = spark.createDataFrame([(["crore", "lakh"],), (["crore", "ed"],), ([],)], "terms array<string>")
    got = {r["category"]: (r["n_terms"], r["n_terms_found"], r["n_mentions"]) for r in terms_by_category(df, "terms").collect()}
    assert got["numbers"] == (5, 2, 3)
    assert got["institutions"] == (11, 1, 1)
    assert got["admin"] == (6, 0, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["crore", "2020", "IAS", "1999", "May 1, 2001", "plain"]), max_size=6), st.data())
def test_scores_stay_in_range_and_grow_with_the_summary(spark, words, data):
    summary = " ".join(words)
    extra = " ".join(data.draw(st.lists(st.sampled_from(["crore", "IAS", "plain"]), max_size=3)))
    source = "IAS and 5 crore in 2020"
    loss = fact.term_loss(T.vocabulary_terms("s"), T.vocabulary_terms("r"))
    before = one(spark, loss, s=summary, r=source)
    after = one(spark, loss, s=summary + " " + extra, r=source)
    assert 0.0 <= after <= before <= 1.0
    assert 0.0 <= temporal(spark, summary, source) <= 1.0
