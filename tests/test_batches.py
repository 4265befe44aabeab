"""Arrow functions take a batch in parts: the same rows, and memory that does not grow with the batch."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from textfacts.functions import batches as B
from textfacts.functions import dates, mentions, rouge, subwords, terms
from textfacts.session import TEST_VOCABULARY

WORDS = ["Dated", "12/03/2004", "May 5, 1999", "minister", "Minister Anil Kumar", "the", "news", "in", "2011", "é日", "running", "won't"]


def texts(n, seed=0):
    chance = random.Random(seed)
    made = [" ".join(chance.choices(WORDS, k=chance.randrange(60))) for _ in range(n)]
    made[1::50] = [None] * len(made[1::50])
    made[2::50] = [""] * len(made[2::50])
    return pa.array(made, pa.string())


def captured(monkeypatch, module, make):
    """The function over Arrow batches that a column function is made of."""
    kept = []
    monkeypatch.setattr(module.F, "arrow_udf", lambda kind: lambda f: kept.append(f) or (lambda *columns: None))
    make()
    return kept[0]


@pytest.fixture(params=["rouge", "stemmed", "terms", "words", "dates", "mentions", "grammar", "encode", "decode"])
def function(request, monkeypatch, spark):
    gazetteer = {"PERSON": ["minister"], "ORG": ["news"]}
    kinds = {
        "rouge": (rouge, lambda: rouge.rouge("a", "b", stemmed=False), 2),
        "stemmed": (rouge, lambda: rouge.rouge("a", "b"), 2),
        "terms": (terms, lambda: terms.find_terms("a", ["minister", "in", "é"]), 1),
        "words": (terms, lambda: terms.find_terms("a", ["minister", "in", "é"], word=True), 1),
        "dates": (dates, lambda: dates.find_dates("a", mentions.DATES), 1),
        "mentions": (mentions, lambda: mentions.find_mentions("a", gazetteer), 1),
        "grammar": (mentions, lambda: mentions.find_mentions("a", gazetteer, grammar=mentions.NameGrammar()), 1),
        "encode": (subwords, lambda: subwords.encode_subwords("a", subwords.read_vocabulary(TEST_VOCABULARY)), 1),
        "decode": (subwords, lambda: subwords.decode_subwords("a", subwords.read_vocabulary(TEST_VOCABULARY)), 1),
    }
    module, make, columns = kinds[request.param]
    run = captured(monkeypatch, module, make)

    def inputs(n):
        if request.param == "decode":
            return [pa.array([None if t is None else [5 + len(t) % 40] * len(t) for t in texts(n).to_pylist()], pa.list_(pa.int32()))]
        return [texts(n, seed) for seed in range(columns)]

    return run, inputs


def test_parts_give_the_rows_of_the_whole(function, monkeypatch):
    run, inputs = function
    whole = run(*inputs(300))
    for size in (1, 1000, 7000):
        monkeypatch.setattr(B, "PART_BYTES", size)
        got = run(*inputs(300))
        assert got.type == whole.type and got.to_pylist() == whole.to_pylist()
    assert len(run(*[c.slice(0, 0) for c in inputs(3)])) == 0


def test_memory_does_not_grow_with_the_batch(function, monkeypatch):
    run, inputs = function
    monkeypatch.setattr(B, "PART_BYTES", 1 << 14)

    def peak(n):
        columns = inputs(n)
        tracemalloc.start()
        run(*columns)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    run(*inputs(10))  # what is built once
    peak(100)
    assert peak(4000) < 2 * peak(400) + 200_000


def test_a_long_row_is_a_part_of_its_own():
    column = pa.array(["ab", "c" * 50, None, "", "defg", "hi"], pa.string())
    assert [p[0].to_pylist() for p in B.parts(column, limit=6)] == [["ab"], ["c" * 50], [None, "", "defg", "hi"]]


def test_pairs_that_stand_beside_each_other_several_times(monkeypatch):
    seen = []
    counted = rouge._scored
    monkeypatch.setattr(rouge, "_scored", lambda codes, *rest: seen.append(len(rest[0])) or counted(codes, *rest))
    left = pa.array(["a b c", "a b c", None, "a b c", "x y", ""], pa.string())
    right = pa.array(["b c", "b c", "b c", "a", "b c", None], pa.string())
    got = rouge.score_texts(left, right).to_pylist()
    assert got == rouge.score_batch(*[pa.array([None if t is None else t.split() for t in c.to_pylist()], pa.list_(pa.string())) for c in (left, right)]).to_pylist()
    assert got[0] == got[1] and seen[0] == 5
