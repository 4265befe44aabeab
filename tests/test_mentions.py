"""Names by the grammar, and the term search with letters that fold."""

import pytest
from conftest import rows

from textfacts.functions import text as T
from textfacts.functions.mentions import NameGrammar
from textfacts.operators.factuality import GAZETTEER

ORGS = {"ORG": GAZETTEER["ORG"]}


def named(spark, text, gazetteer=ORGS, dates=False, grammar=None):
    df = spark.createDataFrame([(text,)], "t string")
    found = rows(df.select(T.typed_mentions("t", gazetteer, dates, grammar or NameGrammar())))[0][0]
    return None if found is None else [tuple(m) for m in found]


@pytest.mark.parametrize(
    "text, mentions",
    [
        ("Chief Minister Anil Kumar spoke.", [("PERSON", "Chief Minister Anil Kumar")]),
        ("the chief minister Anil Kumar", [("PERSON", "chief minister Anil Kumar")]),
        ("the Chief Minister spoke", []),
        ("Minister The", []),
        ("Prime Minister Élodie O'Neil-Çelik, MP", [("PERSON", "Prime Minister Élodie O'Neil-Çelik")]),
        ("MP Anil BJP", [("PERSON", "MP Anil"), ("ORG", "BJP")]),
        ("MLA MP Rao", [("PERSON", "MP Rao")]),
        ("MPs Rao, xMP Rao, MP. Rao", []),
        ("in Anand Nagar Panchayat today", [("GPE", "Anand Nagar Panchayat")]),
        ("The Panchayat of", []),
        ("Gram Sabha Rampur met", [("GPE", "Gram Sabha Rampur")]),
        ("In Pune Gram Sabha Rampur met", [("GPE", "Pune Gram Sabha")]),
        ("BJP Panchayat", [("ORG", "BJP")]),
        ("Minister Rao Panchayat", [("PERSON", "Minister Rao")]),
        ("日本 Minister\tRao 日", [("PERSON", "Minister\tRao")]),
        ("Minister\nRao", []),
        ("", []),
        (None, None),
    ],
)
def test_grammar(spark, text, mentions):
    assert named(spark, text) == mentions


def test_dates_come_last_and_once(spark):
    assert named(spark, "2020 MP Rao 2020, RBI 1/2/2021", dates=True) == [("PERSON", "MP Rao"), ("ORG", "RBI"), ("DATE", "1/2/2021"), ("DATE", "2020"), ("DATE", "2021")]


def test_own_grammar_and_gazetteer(spark):
    grammar = NameGrammar(titles=("Dr", "Prof"), place_words=("Lake",), place="LOC")
    text = "Dr Who at Crater Lake and Lake Como with UNO, Prof Dr Rao"
    assert named(spark, text, {"ORG": ["uno"], "BAND": ["Who"]}, grammar=grammar) == [
        ("BAND", "Who"), ("LOC", "Crater Lake"), ("LOC", "Lake Como"), ("ORG", "UNO"), ("PERSON", "Dr Rao"),
    ]


def test_letters_that_fold_to_ascii(spark):
    df = spark.createDataFrame([("é SEBI ſebi Karma ISRO",)], "t string")
    found = rows(df.select(T.typed_mentions("t", {"ORG": ["SEBI", "ISRO"], "X": ["karma"]}, False)))[0][0]
    assert [tuple(m) for m in found] == [("ORG", "SEBI"), ("ORG", "ſebi"), ("ORG", "ISRO"), ("X", "Karma")]


def test_a_term_of_two_types(spark):
    df = spark.createDataFrame([("the ED of ED",)], "t string")
    found = rows(df.select(T.typed_mentions("t", {"A": ["ed"], "B": ["ED", "of"]}, False)))[0][0]
    assert [tuple(m) for m in found] == [("A", "ED"), ("A", "ED"), ("B", "ED"), ("B", "of"), ("B", "ED")]


def test_very_long_names(spark):
    name = " ".join(["Anil"] * 3000)
    assert named(spark, f"MP {name} x {name} Panchayat") == [("PERSON", f"MP {name}"), ("GPE", f"{name} Panchayat")]
