import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts.functions import text as T


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, count",
    [
        ("one\ntwo\tthree four\x1cfive", 5),
        ("  padded  out  ", 2),
        ("", 0),
        ("   ", 0),
        (None, None),
        ("a b　c\x85d e", 5),
        ("joined​by zero-width", 2),
    ],
)
def test_word_count_is_python_split(spark, value, count):
    assert one(spark, value, T.word_count("t")) == count
    if value is not None:
        assert len(value.split()) == count


def test_every_python_space_splits(spark):
    import sys

    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    assert one(spark, "x".join(["", *spaces, ""]), T.word_count("t")) == len(spaces) + 1


def test_words_beside_other_characters(spark):
    assert one(spark, " bébé  \U0001f600 z ", T.words("t")) == ["bébé", "\U0001f600", "z"]


MIXED = "on May 12, 2020 and june 15 2021, 12/05/2020 id123456 x2020y"


def test_dates_anywhere_and_as_words(spark):
    assert set(one(spark, MIXED, T.date_mentions("t"))) == {
        "12/05/2020", "2020", "2021", "1234", "May", "jun",
    }
    assert set(one(spark, MIXED, T.date_mentions("t", year=T.WORD_YEAR))) == {
        "12/05/2020", "2020", "2021", "May", "jun",
    }


def test_full_dates(spark):
    found = one(spark, "on 3 March 2019 and May 12, 2020", T.date_mentions("t", full_dates=True))
    assert set(found) == {"3 March 2019", "May 12, 2020", "2019", "2020"}


def test_unicode_digits_and_word_ends(spark):
    arabic = "١٩٩٩"
    text = f"{arabic} café2020 2020é "
    assert set(one(spark, text, T.date_mentions("t"))) == {arabic, "2020"}
    assert one(spark, text, T.date_mentions("t", year=T.WORD_YEAR)) == [arabic]


def test_long_s_matches_in_month_names(spark):
    assert "ſep" in one(spark, "ſep 1 1999", T.date_mentions("t"))


@pytest.mark.parametrize("value", ["", None, "no dates here"])
def test_no_dates(spark, value):
    assert one(spark, value, T.date_mentions("t")) == []


def test_vocabulary_has_56_terms_in_6_categories():
    listed = T.vocabulary_rows()
    assert len(listed) == 56
    assert len({c for c, _ in listed}) == 6


SOURCE = "Two crore for the new IAS school was voted by the Lok Sabha."


def test_vocabulary_substring_and_word(spark):
    assert one(spark, SOURCE, T.vocabulary_terms("t")) == ["crore", "ias", "lok sabha", "ed"]
    assert one(spark, SOURCE, T.vocabulary_terms("t", match="word")) == ["crore", "ias", "lok sabha"]
    assert one(spark, None, T.vocabulary_terms("t")) == []
    assert one(spark, "10 lakhs", T.vocabulary_terms("t")) == ["lakh", "lakhs"]
    assert one(spark, "10 lakhs", T.vocabulary_terms("t", match="word")) == ["lakhs"]


def test_vocabulary_terms_are_literal_text(spark):
    assert one(spark, "a.b axb (c", T.vocabulary_terms("t", ["a.b", "(c", "x."], match="word")) == ["a.b", "(c"]


def test_unknown_match_mode():
    with pytest.raises(ValueError):
        T.vocabulary_terms("t", match="fuzzy")


def test_typed_mentions_keep_case_and_repeats(spark):
    gazetteer = {"PERSON": ["Minister", "Prime Minister"], "ORG": ["RBI"]}
    text = "The prime minister met the RBI. Rbi and RBIs, PRIME MINISTER, minister on May 12, 2020"
    found = [(m["type"], m["text"]) for m in one(spark, text, T.typed_mentions("t", gazetteer))]
    assert found == [
        ("PERSON", "prime minister"), ("PERSON", "PRIME MINISTER"), ("PERSON", "minister"),
        ("ORG", "RBI"), ("ORG", "Rbi"), ("DATE", "2020"), ("DATE", "May 12, 2020"),
    ]


def test_rouge_tokens_split_at_accents(spark):
    assert one(spark, "Café-Crème 3.5!", T.rouge_tokens("t")) == ["caf", "cr", "me", "3", "5"]


@pytest.mark.parametrize(
    "model_id, prefixed, long_context",
    [
        ("t5-base", True, False),
        ("google/mt5-base", True, False),
        ("google/long-t5-tglobal-base", True, False),
        ("facebook/bart-base", False, False),
        ("allenai/led-large-16384-arxiv", False, True),
        ("sshleifer/distilbart-cnn-12-6", False, False),
    ],
)
def test_prompt_and_context_by_model(spark, model_id, prefixed, long_context):
    text = one(spark, model_id, T.with_prompt(F.lit("news"), "t"))
    assert text == ("summarize: news" if prefixed else "news")
    assert one(spark, model_id, T.is_long_context("t")) is long_context


def test_preview_slug_and_contains(spark):
    assert one(spark, "x" * 300, T.preview("t")) == "x" * 200 + "..."
    assert one(spark, "BART-Large/CNN", T.slug("t")) == "bart_large_cnn"
    assert one(spark, None, T.contains_text("t", "LED")) is False
    assert one(spark, "LED-ArXiv", T.contains_text("t", "LED")) is True


def test_truncation_counts_code_points(spark):
    assert one(spark, "\U0001f600" * 5, T.truncate_chars("t", 3)) == "\U0001f600" * 3


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]
