"""Subword ids against a plain merge loop and against another encoder of the same file."""

import json

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfacts.functions import subwords as S
from textfacts.operators import examples as X
from textfacts.session import TEST_VOCABULARY

SOURCE = S.read_vocabulary(TEST_VOCABULARY)
SUBWORDS = S.Subwords(SOURCE)
TEXTS = st.text("abcthe é'sn1 \n\t日👍<|>", max_size=40)


def plain_merges(word):
    """One merge at a time: the first of the pairs with the lowest rank."""
    parts = [SUBWORDS.letters[b] for b in word.encode()]
    while True:
        known = [(SUBWORDS.ranks[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in SUBWORDS.ranks]
        if not known:
            return [SUBWORDS.ids[p] for p in parts]
        k = min(known)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@given(TEXTS)
def test_merges_and_round_trip(text):
    ids = list(SUBWORDS.encode(text))
    assert ids == [i for word in SUBWORDS._words.findall(text) for i in plain_merges(word)]
    assert SUBWORDS.decode(ids) == text


def test_same_ids_as_another_encoder(spark, folder):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(TEST_VOCABULARY)
    library.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + ["", " ", "a  b\n\n c's", "<|endoftext|>", "aaaa" * 50]
    for text in texts:
        assert list(SUBWORDS.encode(text or "")) == library.encode(text or "", add_special_tokens=False).ids


def test_small_vocabulary_of_pairs_as_texts():
    letters = S.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    made = S.Subwords(json.dumps({"model": {"vocab": vocab, "merges": ["a b", "ab c"]}}))
    assert list(made.encode("abcab")) == [257, 256]


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([("the cat",), ("",), (None,)], "t string")
    ids = df.select(S.encode_subwords("t", SOURCE).alias("ids"))
    assert [r["ids"] for r in ids.collect()] == [list(SUBWORDS.encode("the cat")), [], None]
    assert [r[0] for r in ids.select(S.decode_subwords("ids", SOURCE)).collect()] == ["the cat", "", None]


def test_training_examples_of_subwords(spark):
    df = spark.createDataFrame([(1, "Reunions of unions", "a sum")], "id int, article string, summary string")
    row = X.training_examples(df, None, article_tokens=12, summary_tokens=3, subwords=SOURCE).first()
    ids = list(SUBWORDS.encode("Reunions of unions"))
    assert row["input_ids"] == ids + [1] * (12 - len(ids)) and sum(row["attention_mask"]) == len(ids)
    assert row["labels"] == [*SUBWORDS.encode("a sum"), -100][:3]


def test_joined_ids_equal_sent_ids(spark):
    from textfacts.functions import encoding as E

    words = [f"w{k}" for k in range(50)]
    data = [(k, [words[(k * j) % 60 % 50] if (k + j) % 7 else "other" for j in range(k)]) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(data, "k int, w array<string>").repartition(3)
    table = spark.createDataFrame([(w, E.FIRST_TOKEN_ID + i) for i, w in enumerate(words)], "token string, token_id int")
    got = X.encode_joined(df, "k", "w", table).withColumn("sent", E.encode("w", words))
    assert got.where(~F.col("ids").eqNullSafe(F.col("sent"))).count() == 0 and got.count() == 41
    assert rows(got.where("k = 0"), "ids") == [([],)]
