from collections import Counter

import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from textfacts.llm import automata, collocations

TEXTS = st.lists(st.tuples(st.sampled_from([None, "en", "und", "a b"]), st.text("ab .\tC\né", max_size=30)), max_size=8)


def brute_counts(docs):
    found = Counter()
    for lang, text in docs:
        words = collocations.pieces_words(text)
        pieces, piece = [], []
        for w in [*words, b"\xff"]:
            if w == b"\xff":
                pieces.append(piece)
                piece = []
            else:
                piece.append(w)
        for p in pieces:
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    found[((lang or "und").encode(), *p[i : i + n])] += 1
    return found


def sequences(words, levels):
    words, out, above = words.to_pylist(), {}, [()]
    for level in levels:
        above = [(*above[p], words[i]) for p, i in zip(level.parent.tolist(), level.label.tolist(), strict=True)]
        out |= {s: w for s, w in zip(above, level.weight.tolist(), strict=True) if w}
    return out


@given(TEXTS, TEXTS)
def test_automata_keep_counts_and_unions_add_them(one, two):
    built = [automata.minimal(*collocations.counted([t for _, t in docs], [la for la, _ in docs])) for docs in (one, two)]
    for docs, automaton in zip((one, two), built, strict=True):
        assert sequences(*automata.union([automaton])) == brute_counts(docs)
    assert sequences(*automata.union(built)) == brute_counts(one) + brute_counts(two)


@given(TEXTS, st.integers(1, 9))
def test_ranges_divide_the_phrases(docs, ranges):
    words, levels = collocations.counted([t for _, t in docs], [la for la, _ in docs])
    found = {}
    for place, automaton in collocations.cut(words, levels, ranges):
        for phrase, count in sequences(*automata.union([automaton])).items():
            assert phrase not in found
            assert collocations.range_of_phrase([phrase[0]], [phrase[1:]], ranges)[0] == place
            found[phrase] = count
    assert found == brute_counts(docs)


def test_states_with_equal_futures_are_shared():
    words = pa.array([b"a", b"b", b"c"], pa.binary())
    levels = automata.trie([(0, 2), (0, 1, 2), (1, 2), (1, 1, 2)], [5, 7, 5, 7])
    automaton = automata.minimal(words, levels)
    assert len(automaton.weights) == 5  # both first words lead to the same state
    one_by_one = automata.Builder()
    one_by_one.add(automata.trie([(0, 2), (0, 1, 2)], [5, 7]))
    one_by_one.add(automata.trie([(1, 2), (1, 1, 2)], [5, 7]))
    assert len(one_by_one.finish(words).weights) == 5


def test_composition_gives_counts_of_known_sequences_only():
    known = automata.minimal(pa.array([b"a", b"b"], pa.binary()), automata.trie([(0,), (0, 1), (1,)], [3, 2, 4]))
    words = pa.array([b"b", b"x", b"a"], pa.binary())
    wanted = automata.trie([(2, 0), (1, 0), (0, 0), (2,)], [0, 0, 0, 0])
    counts = automata.compose(words, wanted, known)
    got = {(words[i].as_py(),): int(c) for i, c in zip(wanted[0].label, counts[0], strict=True)}
    assert got == {(b"b",): 4, (b"x",): 0, (b"a",): 3}
    assert sorted(counts[1].tolist()) == [0, 0, 2]


def brute(docs, least=10, per_lang=2000):
    f = brute_counts(docs)
    out = []
    for lang in {k[0] for k in f}:
        n = sum(c for k, c in f.items() if k[0] == lang and len(k) == 2)
        cand = {k[1:]: c for k, c in f.items() if k[0] == lang and len(k) > 2 and c >= least}
        found = []
        for phrase, a in cand.items():
            if any(len(q) == 3 and phrase in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cand.items() if len(phrase) == 2):
                continue
            score, _, left, right = min(
                (10**6 * a * a // (f[lang, *phrase[:k]] * f[lang, *phrase[k:]]), k, f[lang, *phrase[:k]], f[lang, *phrase[k:]]) for k in range(1, len(phrase))
            )
            found.append((-score, -a, b" ".join(phrase), left, right))
        found.sort()
        out += [(lang.decode(), i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(found[:per_lang], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    import random

    r = random.Random(5)
    words = ["the", "of", "Union", "sum", "é", "x|y", "\x00", "word\x1cword"]
    made = [(r.choice([None, "en", "fr"]), " ".join(r.choice(words) + r.choice(["", "", "", ".", "\n", "\t "]) for _ in range(60))) for _ in range(60)]
    return [*made, made[0], made[0], (None, None), ("de", ""), ("en", ". ,;"), ("en", "long " * 30_000)]


@pytest.mark.parametrize("range_bytes, fan", [(1 << 20, 256), (2000, 256), (500, 4)])
def test_query_equals_brute_force(spark, corpus, monkeypatch, range_bytes, fan):
    monkeypatch.setattr(collocations, "RANGE_BYTES", range_bytes if range_bytes > 500 else 3000)
    monkeypatch.setattr(collocations, "FAN", fan)
    docs = spark.createDataFrame([(k, la, t, 1, 2) for k, (la, t) in enumerate(corpus)], "doc_id long, lang string, text string, place int, run int")
    got = rows(collocations.collocations(docs.repartition(5), per_lang=15))
    assert sorted(got) == brute(corpus, per_lang=15)


def test_empty_table(spark):
    assert rows(collocations.collocations(spark.createDataFrame([], "text string, lang string"))) == []
    assert rows(collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string"))) == []


def test_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([("en", "a b " * 2_000_000)], "lang string, text string")
    got = rows(collocations.collocations(docs, longer_share=101))
    assert ("en", 1, "a b", 2_000_000, 2_000_000, 2_000_000, 4_000_000, 1_000_000) in got
