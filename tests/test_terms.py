"""The term automaton and the date windows against plain searches."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from textfacts import constants as C
from textfacts.functions import dates as D
from textfacts.functions import terms as M
from textfacts.functions import text as T

LETTERS = st.text("abé日_ 1", max_size=30)


def hits(texts, terms):
    data, starts = M.laid_out(pa.array(texts, pa.string()))
    start, end, term = M.Terms(terms).hits(data)
    row = np.searchsorted(starts, start, side="right") - 1
    free = M.whole_words(data, start, end)
    return [(int(r), bytes(data[a:b]).decode(), terms[t], bool(f)) for r, a, b, t, f in zip(row, start, end, term, free, strict=True)]


@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6), st.lists(st.text("abé日_1", min_size=1, max_size=4), max_size=6, unique=True), st.sampled_from([1, 3, 256]))
def test_all_places_of_all_terms(texts, terms, lane):
    before, M.LANE_BYTES = M.LANE_BYTES, lane
    try:
        got = hits(texts, terms)
    finally:
        M.LANE_BYTES = before
    want = []
    for row, text in enumerate(texts):
        for term in terms:
            for k in range(len(text or "")):
                if text.startswith(term, k):
                    a, b = text[k - 1 : k] if k else "", text[k + len(term) : k + len(term) + 1]
                    want.append((row, term, term, not any(c.isalnum() or c == "_" for c in (a, b))))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("match", ["substring", "word"])
def test_terms_equal_a_plain_search(spark, folder, match):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + [None, "", "Crore, ED and Lok\nSabha; lok sabha"]
    words = sorted({w.lower().strip(".,") for t in texts[:60] if t for w in t.split()} - {""})
    terms = [t for _, t in T.vocabulary_rows()] + words[::3] + [f"{a} {b}" for a, b in zip(words[::40], words[1::40])]
    terms = list(dict.fromkeys(terms))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = dict(rows(df.select("k", T.vocabulary_terms("t", terms, match=match))))
    word = r"(?<![^\W])" + "{}" + r"(?![^\W])"
    for k, text in enumerate(texts):
        lowered = (text or "").lower()
        if match == "substring":
            assert got[k] == [t for t in terms if t in lowered]
        else:
            near = [t for t in terms if t in lowered]
            assert got[k] == [t for t in near if re.search(word.format(re.escape(t)), lowered)]


def test_ten_thousand_terms_cost_about_as_much_as_fifty_six():
    generator = np.random.default_rng(3)
    letters = np.array(list("etaoinshrdlucmfw "))
    texts = pa.array(["".join(letters[generator.integers(0, 17, 3000)]) for _ in range(1500)])
    data, _ = M.laid_out(texts)
    few = M.Terms([t for _, t in T.vocabulary_rows()])
    many = M.Terms(list({"".join(letters[generator.integers(0, 16, n)]) for n in generator.integers(5, 12, 10_500)})[:10_000])

    def seconds(automaton):
        best = np.inf
        for _ in range(3):
            start = time.process_time()
            automaton.hits(data)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(many) <= 2.5 * seconds(few)


DATES = [D.NUMERIC_DATE, D.ANY_YEAR, D.WORD_YEAR, D.MONTH_OF_DATE, D.MONTH_FIRST_DATE, D.DAY_FIRST_DATE]
PARTS = st.sampled_from(["May", "june", "SEPt", "5", "12,", "1999", "1/2/20", "x", "é2020", "١٩٩٩", " ", "\n\t", "\xa0", "　", "-", ".", "日", "03-4-1999"])


@given(st.lists(st.one_of(st.none(), st.lists(PARTS, max_size=12).map("".join)), max_size=5))
def test_windows_hold_every_date(texts):
    joined, begins, row = D.windows(pa.array(texts, pa.string()), 1)
    for pattern in DATES:
        compiled = re.compile(pattern.regex, re.IGNORECASE)
        got = [(int(row[np.searchsorted(begins, m.start(), side="right") - 1]), m[pattern.group]) for m in compiled.finditer(joined)]
        assert got == [(k, m[pattern.group]) for k, t in enumerate(texts) for m in compiled.finditer(t or "")]


def test_own_patterns(spark):
    text = "due Q3 2021, week 14 of 1999; the 5th of June 2020 and summer of 2019"
    quarter = D.DatePattern(r"\bQ([1-4])\s+\d{4}", group=1)
    of_year = D.DatePattern(r"(?:summer|winter)\s+of\s+\d{4}")
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(T.date_mentions("t", patterns=[quarter]))) == [(["3"],)]
    assert rows(df.select(T.date_mentions("t", patterns=[of_year], reach=2))) == [(["summer of 2019"],)]
    assert rows(df.select(T.date_mentions("t", patterns=[]))) == [([],)]


def test_dates_after_much_white_space(spark):
    text = "y " * 500 + "January" + " \n" * 4000 + "5," + "\t" * 3000 + "2020" + " x" * 500
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(T.date_mentions("t"))) == [(["2020", "January"[:3]],)]
    assert rows(df.select(T.date_mentions("t", full_dates=True)))[0][0][1].startswith("January \n")


def test_month_list_is_the_fixed_one():
    assert all(m in D.MONTH_FIRST_DATE.regex for m in C.MONTHS)
