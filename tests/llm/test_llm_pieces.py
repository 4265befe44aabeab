import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from textfacts.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def best_score(word, vocabulary):
    """All segmentations, without sharing anything."""
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [best[end - 1] + vocabulary.unknown]
        options += [best[a] + vocabulary.scores[word[a:end]] for a in range(end) if word[a:end] in vocabulary.scores]
        best[end] = max(options)
    return best[-1]


def score_of(ids, word, vocabulary):
    spelled = {i: p for p, i in vocabulary.ids.items()}
    total = sum(vocabulary.scores[spelled[i]] for i in ids if i in spelled)
    return total + vocabulary.unknown * sum(c not in vocabulary.ids for c in word)


@given(st.lists(st.text("thern ▁<0xé\n", max_size=25), max_size=12))
def test_no_segmentation_scores_more(words):
    vocabulary = pieces.load_vocabulary()
    for word, ids in pieces.segment(set(words), vocabulary).items():
        assert score_of(ids, word, vocabulary) == pytest.approx(best_score(word, vocabulary))


def test_same_ids_as_the_library_in_its_unigram_mode(vocabulary):
    model = pb.ModelProto()
    model.ParseFromString(open(pieces.VOCABULARY, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:  # keep the library's 32-bit sums exact
        piece.score = max(piece.score, -40000.0)
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    ours = pieces.load_vocabulary()
    ours.scores = {p: max(s, -40000.0) for p, s in ours.scores.items()}
    ours.__post_init__()
    text = "The quick brown fox, thhehention erstly! Größe ueiéñ straße\nnewlines  two blanks"
    for word in [*text.split(), text]:
        assert pieces.Encoder(ours).encode([word])[0] == library.encode(word)


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_round_trip(texts):
    vocabulary = pieces.load_vocabulary()
    ids = pieces.Encoder(vocabulary).encode(texts)
    assert [pieces.decode(i, vocabulary) for i in ids] == [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]


def test_forgetting_words_changes_nothing(vocabulary, monkeypatch):
    texts = [f"word{i} thing{i % 7} and {i * i}" for i in range(300)]
    want = pieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    encoder = pieces.Encoder(vocabulary)
    assert [encoder.encode([t])[0] for t in texts] == want


def test_frames(spark, vocabulary):
    data = [(1, None), (2, ""), (3, "a  b ▁ c\n"), (3, "a  b ▁ c\n"), (None, "x" * 50_000 + " é" * 2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(0)}).repartition(2)
    got = pieces.encoded(docs, vocabulary)
    assert got.columns == ["doc_id", "text", "decoded", "ids"]
    back = pieces.decoded(got, vocabulary)
    assert sorted(rows(back, "doc_id", "decoded"), key=repr) == sorted(data, key=repr)
    told = {r["doc_id"]: (r["n_tokens"], r["round_trip"]) for r in pieces.digests(docs, vocabulary).collect()}
    assert told[1] == (None, True) and told[2] == (0, True) and told[3][1] and told[None][1]
    assert pieces.encoded(docs.where("false"), vocabulary).count() == 0


def test_query(spark, folder):
    got = pieces.op8_pieces(spark, folder)
    assert got.where("not round_trip").count() == 0
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
