import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts.llm import nearcopies as near
from textfacts.llm.components import connected


def slow(data):
    """(doc_id, class_id, n_links, n_copies) by comparing all pairs."""

    def shingles(text):
        words = (text or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None

    texts, out = defaultdict(list), []
    for doc_id, text in data:
        if (s := shingles(text)) is None:
            out.append((doc_id, doc_id, 0, 1))
        else:
            texts[s].append(doc_id)
    sets = list(texts)
    links, root = [0] * len(sets), list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    for i, s in enumerate(sets):
        ids = [d for k, r in enumerate(root) if r == root[i] for d in texts[sets[k]] if d is not None]
        out += [(d, min(ids, default=None), links[i], len(texts[s])) for d in texts[s]]
    return sorted(out, key=repr)


def made(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    data = []
    for base in range(12):
        text = draw.choices(words, k=draw.randrange(6, 260))
        for _ in range(draw.randrange(1, 12)):
            copy = list(text)
            for _ in range(draw.randrange(0, max(1, len(text) // 30) + 1)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            data.append(" ".join(copy))
    data += ["", "  \n", None, "one two", "one  two", "one two three four", "w1"] + data[:5]
    draw.shuffle(data)
    return list(enumerate(data))


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 3)])
def test_same_as_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near, "BLOCK", block)
    data = made(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"key": F.lit("clash"), "component": F.lit(1)}).repartition(3)
    got = near.near_copies(docs).select("doc_id", "class_id", "n_links", "n_copies")
    assert sorted(rows(got), key=repr) == slow(data)


def test_query_is_what_all_pairs_give(spark, folder):
    data = rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    assert sorted(rows(near.op1_near_copies(spark, folder)), key=repr) == slow(data)


def test_one_of_each_keeps_columns_and_wordless_texts(spark):
    text = " ".join(f"a{i}" for i in range(60))
    data = [(4, text, "x"), (2, text + " tail", "y"), (2, text + " tail", "y"), (9, "other words that stand alone here", "z"), (5, "", "e"), (6, None, "n"), (None, text, "q")]
    docs = spark.createDataFrame(data, "doc_id long, text string, key string").repartition(2)
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(rows(got), key=repr) == sorted([(2, text + " tail", "y"), (9, "other words that stand alone here", "z"), (5, "", "e"), (6, None, "n")], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_copies(docs).count() == 0
    assert near.one_of_each(docs).count() == 0


def test_very_long_texts(spark):
    words = [f"v{i}" for i in range(60_000)]
    data = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:40_001]))]
    got = near.near_copies(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_pruning_drops_no_link():
    draw = np.random.default_rng(3)
    base = np.unique(draw.integers(0, 1 << 62, 500, dtype=np.uint64))
    sets = []
    for _ in range(60):
        keep = draw.random(len(base)) > draw.random() * 0.25
        sets.append(np.unique(np.concatenate([base[keep], draw.integers(0, 1 << 62, int(draw.integers(0, 60)), dtype=np.uint64)])))
    want = {(i, j) for i, j in combinations(range(60), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    i, j = near.links_of(sets, None)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and 50 < len(want) < 1700
    i, j = near.links_of(sets[:20], sets[20:])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if a < 20 <= b}


def test_least_matches_follow_the_posterior():
    needed = near._least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(needed, needed[1:], strict=False))
    # by summing the posterior itself: Beta(m + 1, n - m + 1) above the threshold
    grid = np.linspace(0, 1, 200_001)
    n, m = 60, needed[60]
    for k, kept in ((m, True), (m - 1, False)):
        density = grid**k * (1 - grid) ** (n - k)
        assert (density[grid >= 0.8].sum() / density.sum() >= 1e-6) == kept


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, k) for k in range(300, 360)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(50)] + [(7, 7), (None, 3)]
    got = dict(rows(connected(spark.createDataFrame(edges, "u long, v long"))))
    root = {n: n for e in edges for n in e if n is not None and e[0] is not None and e[0] != e[1]}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root[a], root[b]
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    assert got == root
