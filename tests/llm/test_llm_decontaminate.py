import random

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfacts.llm import decontaminate as dc


def slow_distance(item, text):
    """Sellers' table."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=120))
def test_myers_is_the_least_distance(item, text):
    assert dc.Pattern(item).distance(text) == slow_distance(item, text)


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for k in range(n):
            pieces = dc.split_evenly("x" * n, k)
            assert len(pieces) == k + 1 and sum(len(p) for _, p in pieces) == n and all(p for _, p in pieces)


def edited(text, n, draw):
    for _ in range(n):
        at = draw.randrange(len(text))
        text = draw.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(30))
def test_every_match_within_the_budget_is_found(seed):
    draw = random.Random(seed)
    words = ["the", "and", "thed", "er", "ing", "onth"]
    items = [(i, dc.normal(" ".join(draw.choices(words, k=draw.randrange(5, 40))))) for i in range(4)]
    matcher = dc.Matcher(items, 0.1)
    text = "".join(" ".join(draw.choices(words, k=20)) + " " + edited(item, draw.randrange(0, 8), draw) for _, item in items)
    want = []
    for k, (i, item) in enumerate(items):
        best = slow_distance(item, dc.normal(text))
        if best <= matcher.budgets[k]:
            want.append((i, best, matcher.budgets[k]))
    assert sorted(matcher.find(text)) == want


def test_nulls_empty_texts_ties_and_clashing_columns(spark):
    item = "a rather long benchmark item that nobody would write by chance"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f"x {item.upper()}\n y"), (3, f"x {item.upper()}\n y"), (None, item), (5, "clean " * 3000)], "doc_id long, text string")
    docs = docs.withColumns({"item_id": F.lit(0), "distance": F.lit(0)}).repartition(3)
    bench = spark.createDataFrame([(1, item), (2, item), (None, " "), (4, None)], "item_id long, text string")
    assert sorted(rows(dc.contaminated(docs, bench)), key=repr) == sorted([(d, i, 0, 3) for d in (3, 3, None) for i in (1, 2)], key=repr)
    kept = dc.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).count() == 0
    assert dc.decontaminated(docs, none).count() == 1
    assert dc.contaminated(docs.where("false"), spark.createDataFrame([(1, "text")], "item_id long, text string")).count() == 0


def test_blocks_hold_every_item(spark):
    bench = spark.createDataFrame([(i, f"item {i} " * 10) for i in range(100)], "item_id long, text string")
    blocks = list(dc.item_blocks(bench, 2000))
    assert len(blocks) == 4 and sorted(i for b in blocks for i, _ in b) == list(range(100))
