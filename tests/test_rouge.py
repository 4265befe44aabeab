import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from textfacts.functions.rouge import lcs_length, rouge, score_batch, score_texts
from textfacts.functions.stemming import rouge_stem, stem


def f_measure(overlap, reference, candidate):
    p, r = overlap / max(candidate, 1), overlap / max(reference, 1)
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def ngram_f(ref, cand, n):
    a = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
    b = Counter(tuple(cand[i:i + n]) for i in range(len(cand) - n + 1))
    return f_measure(sum((a & b).values()), sum(a.values()), sum(b.values()))


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


TOKENS = st.lists(st.sampled_from("abcde"), max_size=25)


@given(TOKENS, TOKENS)
def test_lcs_against_the_table(a, b):
    assert lcs_length([ord(x) for x in a], [ord(x) for x in b]) == table_lcs(a, b)


@given(TOKENS, TOKENS, st.integers(1, 9))
def test_lcs_in_blocks(a, b, block):
    codes = [ord(x) for x in a], [ord(x) for x in b]
    assert lcs_length(*codes, block=block) == table_lcs(a, b)


@given(st.lists(st.tuples(TOKENS, TOKENS), min_size=1, max_size=8))
def test_batches_against_one_pair_at_a_time(batch):
    refs, cands = zip(*batch)
    kind = pa.list_(pa.string())
    got = score_batch(pa.array(refs, kind), pa.array(cands, kind)).to_pylist()
    for ref, cand, row in zip(refs, cands, got):
        assert row["rouge1"] == pytest.approx(ngram_f(ref, cand, 1))
        assert row["rouge2"] == pytest.approx(ngram_f(ref, cand, 2))
        assert row["rougeL"] == pytest.approx(f_measure(table_lcs(ref, cand), len(ref), len(cand)))


def test_long_texts_are_scored_whole():
    ref = [f"w{i % 977}" for i in range(6000)]
    cand = ref[3000:] + ref[:1500]
    kind = pa.list_(pa.string())
    row = score_batch(pa.array([ref], kind), pa.array([cand], kind)).to_pylist()[0]
    assert row["rouge2"] == pytest.approx(ngram_f(ref, cand, 2))
    assert row["rougeL"] == pytest.approx(f_measure(table_lcs(ref, cand), len(ref), len(cand)))


def test_sliced_arrays_and_nulls():
    kind = pa.list_(pa.string())
    refs = pa.array([["x"], ["a", "b"], None, ["c"]], kind).slice(1)
    cands = pa.array([["y"], ["a", "b"], ["c"], None], kind).slice(1)
    got = score_batch(refs, cands).to_pylist()
    assert got[0] == {"rouge1": 1.0, "rouge2": 1.0, "rougeL": 1.0}
    assert got[1] == got[2] == {"rouge1": None, "rouge2": None, "rougeL": None}


def test_column_function(spark):
    df = spark.createDataFrame(
        [("the cat sat on mat", "The cat on the mat!"), ("one", "one"), ("", "x"), (None, "x")],
        "r string, c string",
    ).coalesce(1)
    got = [r["s"] for r in df.select(rouge("r", "c", stemmed=False).alias("s")).collect()]
    assert got[0]["rougeL"] == pytest.approx(0.8)
    assert (got[1]["rouge1"], got[1]["rouge2"]) == (1.0, 0.0)  # one token has no bigram
    assert (got[2]["rouge1"], got[2]["rougeL"]) == (0.0, 0.0)
    assert got[3]["rouge1"] is None


def test_metrics_left_out_are_null(spark):
    df = spark.createDataFrame([("a b", "a b")], "r string, c string")
    row = df.select(rouge("r", "c", ("rouge2",)).alias("s")).first()["s"]
    assert (row["rouge1"], row["rouge2"], row["rougeL"]) == (None, 1.0, None)
    with pytest.raises(ValueError):
        rouge("r", "c", ("rouge9",))


def test_stems_make_word_forms_equal(spark):
    df = spark.createDataFrame([("ministers announced policies", "minister announces policy")], "r string, c string")
    assert df.select(rouge("r", "c")["rouge1"].alias("x")).first()["x"] == 1.0
    assert df.select(rouge("r", "c", stemmed=False)["rouge1"].alias("x")).first()["x"] == 0.0


# Examples printed with the algorithm's publication, and the departures.
@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("valenci", "valenc"), ("digitizer", "digit"),
        ("radicalli", "radic"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"),
        ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("sensibiliti", "sensibl"),
        ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"), ("replacement", "replac"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("skies", "sky"), ("dying", "die"), ("died", "die"), ("news", "news"), ("enjoy", "enjoy"), ("say", "say"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_short_tokens_are_not_stemmed():
    assert [rouge_stem(w) for w in ("was", "his", "goes", "2020s")] == ["was", "his", "goe", "2020"]


@given(st.lists(st.tuples(st.one_of(st.none(), st.text("abA é.1_", max_size=12)), st.one_of(st.none(), st.text("abA é.1_", max_size=12))), max_size=6))
def test_texts_score_like_their_tokens(pairs):
    def tokens(text):
        return None if text is None else re.sub("[^a-z0-9]+", " ", text.lower()).split()

    kind = pa.list_(pa.string())
    pairs = [p for pair in pairs for p in (pair, pair)]  # neighbours with one reference
    lowered = [[None if t is None else t.lower() for t in side] for side in zip(*pairs)] if pairs else [[], []]
    got = score_texts(*(pa.array(side, pa.string()) for side in lowered))
    want = score_batch(*(pa.array([tokens(p[k]) for p in pairs], kind) for k in (0, 1)))
    assert got.to_pylist() == want.to_pylist()
