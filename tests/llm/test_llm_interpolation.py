import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textfacts.llm import interpolation as lm


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % lm.DIVISOR == lm.HELD_OUT


def halves(spark, ids):
    found = spark.createDataFrame([(k,) for k in ids], "doc_id long").distinct().select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    return dict(map(tuple, found.collect()))


def brute(corpus, half_of):
    """Counts in dictionaries, the histogram without steps, expectation-maximisation token by token."""
    docs = [(k, held(k), [b" ", b" ", *lm.tokens(t), b"\n"]) for k, t in corpus]
    counts = [Counter() for _ in range(2)]
    for k, out, s in docs:
        if not out:
            c = counts[half_of[k]]
            c[b" ",] += 1
            c[b" ", b" "] += 1
            for i in range(2, len(s)):
                c.update([(s[i],), tuple(s[i - 1 : i + 1]), tuple(s[i - 2 : i + 1])])
    whole = counts[0] + counts[1]
    size = lambda c: sum(n for g, n in c.items() if len(g) == 1 and g != (b" ",))
    v = sum(len(g) == 1 and g != (b" ",) for g in whole)
    log2 = lambda n: int(lm.bucket(np.array([n]))[0])

    def parts(c, s, i):
        n = size(c)
        before, context = c[s[i - 1],], c[tuple(s[i - 2 : i])]
        share = lambda a, b: a / b if b else 0.0
        return [(share(c[s[i],], n), 0), (share(c[tuple(s[i - 1 : i + 1])], before), log2(before)), (share(c[tuple(s[i - 2 : i + 1])], context), log2(context))]

    weights = []

    def prob(found):
        p = 1 / (v + 1)
        for (f, b), k in zip(found, weights):
            p = k[b] * f + (1 - k[b]) * p
        return p

    for level in range(3):
        events = []
        for k, out, s in docs:
            if not out:
                for i in range(2, len(s)):
                    found = parts(counts[1 - half_of[k]], s, i)
                    events.append((found[level][1], found[level][0] / prob(found)))
        where, ratio = np.array([e[0] for e in events], int), np.array([e[1] for e in events])
        k = lm.fitted(where, np.ones(len(events)), ratio)
        if level:
            k[0] = 0
        weights.append(k)
    n = size(whole)
    out = []
    for k, is_held, s in docs:
        words = s[2:]
        base = sum(math.log10((whole[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = sum(math.log10(prob(parts(whole, s, i))) for i in range(2, len(s)))
        out.append((k, is_held, len(words), sum(whole[w,] > 0 for w in words), n, base, score))
    vocabulary = [*(g[0] for g in whole if len(g) == 1 and g != (b" ",)), b"an unknown word"]
    return out, weights, lambda u, w: sum(prob(parts(whole, [u, w, x], 2)) for x in vocabulary)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = ["the", "Of", "union", "é", "x\x00y", "sum"]
    made = [(k, " ".join(r.choices(words, [9, 5, 3, 2, 1, 1], k=r.randint(0, 60)))) for k in range(150)]
    return [*made, made[3], made[3], (None, "the of"), (200, None), (201, ""), (202, "\n \t"), (203, "word " * 20_000), (204, "never seen before")]


@pytest.mark.parametrize("shard_bytes, fan", [(6 << 20, 512), (300, 512), (300, 4)])
def test_query_equals_brute_force(spark, corpus, monkeypatch, shard_bytes, fan):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "FAN", fan)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in corpus], "doc_id long, text string, fold int, known int")
    got, model = lm.scores(docs.repartition(3), lm.is_remainder(F.col("doc_id"), lm.DIVISOR, lm.HELD_OUT))
    want, weights, _ = brute(corpus, halves(spark, [k for k, _ in corpus]))
    assert all(np.allclose(a, b, atol=0.02) for a, b in zip(model.weights, weights, strict=True))
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[6])) for x in (rows(got), want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-7, rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=0.02, rel=0.005)  # ratios are kept in steps


@pytest.mark.parametrize("context", [(b" ", b" "), (b" ", b"the"), (b"the", b"of"), (b"of", b"\x01 unknown"), (b"word", b"word")])
def test_probabilities_add_up(spark, corpus, context):
    total = brute(corpus, halves(spark, [k for k, _ in corpus]))[2]
    assert total(*context) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_the_base(spark, folder):
    told = lm.op13_language_model(spark, folder).where("held_out").toPandas()
    assert len(told) and told["score"].sum() > told["base_score"].sum()


@given(st.lists(st.tuples(st.floats(0.01, 50), st.integers(1, 9)), min_size=1, max_size=20))
def test_no_other_weight_is_likelier(events):
    ratio, n = (np.array(x, float) for x in zip(*events))
    k = lm.fitted(np.zeros(len(n), int), n, ratio, 1, steps=5000)[0]
    value = lambda x: (n * np.log(x * ratio + 1 - x)).sum()
    assert value(k) >= max(value(x) for x in np.linspace(0, 0.999, 200)) - 1e-3


@given(st.lists(st.integers(-(2**40), 2**62)), st.lists(st.binary(max_size=5).map(lambda b: bytes(c for c in b if c not in b"\n\t ") or b"x")))
def test_packing_round_trip(numbers, words):
    assert lm.numbers_of(lm.squeezed(np.array(numbers, np.int64))).tolist() == numbers
    assert lm.words_of(lm.joined([*words, lm._END]), len(words) + 1) == [*words, lm._END]


@pytest.mark.parametrize("found", [[], [(None, None)], [(1, "a b")]])
def test_small_tables(spark, found):
    docs = spark.createDataFrame(found, "doc_id long, text string")
    for everything in (True, False):
        got = rows(lm.scores(docs, F.lit(everything))[0])
        assert len(got) == len(found) and all(math.isfinite(r[6]) for r in got)
        if everything:
            assert all(r[3] == r[4] == 0 and r[6] == 0 for r in got)


@given(st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \t\n\v\f\r\x1c\x85 AZaz"))))
def test_words_cut_on_bytes_are_the_tokens(texts):
    words, of_each = lm.words_of_each(texts)
    wanted = [lm.tokens(t) for t in texts]
    assert words.to_pylist() == [w for text in wanted for w in text]
    assert of_each.tolist() == list(map(len, wanted))
