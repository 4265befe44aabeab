import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textfacts.llm import alignment

FILES = alignment.read_files()
ENCODER = alignment.Encoder(FILES)
WHOLE_A = Tokenizer.from_file(alignment.A_FILE)
WHOLE_A.encode_special_tokens = True
WHOLE_B = SentencePieceProcessor(model_file=alignment.B_FILE)
ODD = ["", " ", "  x  y ", "<|endoftext|> a", "<s> b </s>", "a b c", "tab\tnew\nline  two", "▁under ▁", "éa è, ç l'é", "日本 語 x", "👍🏽 ok 👍", "\x00 a", "a   b", "x" * 500 + " y"]


def whole(text):
    """Tokens of the whole text by the libraries, and their bytes."""
    a = WHOLE_A.encode(" " + text, add_special_tokens=False).ids
    b = WHOLE_B.encode(text)
    return a, b, [ENCODER.spelled[0][i] for i in a], [ENCODER.spelled[1][i] for i in b]


def brute(texts):
    docs, held = [], Counter()
    for text in texts:
        a, b, x, y = whole(text or "")
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(s) for s in side]).tolist() for side in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for k, (ids, side) in enumerate(zip((a, b), ends, strict=True)):
            for i, e in zip(ids, side, strict=True):
                groups[bisect_left(common, e)][k].append(i)
        pairs = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(pairs))
        docs.append((a, b, groups, pairs))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, pairs = doc
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def flat(found, k):
    return [found.tokens.ids[k][x:y].tolist() for x, y in zip(found.tokens.bounds[k], found.tokens.bounds[k][1:])]


@given(st.lists(st.text("ab e'.\n\té▁<>|日 ", max_size=25), max_size=5))
def test_words_encode_as_the_whole_text(texts):
    found = alignment.align(texts, ENCODER)
    for text, a, b in zip(texts, flat(found, 0), flat(found, 1), strict=True):
        one, two, x, y = whole(text)
        same = text and b"".join(x) == b"".join(y) == (" " + text).encode()
        assert (a, b) == ((one, two) if same else ([], []))


def test_words_encode_as_the_whole_documents(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + ODD
    assert ENCODER.cuts and len(ENCODER.words("one two, three  four")) == 3
    found = alignment.align(texts, ENCODER)
    for text, a, b in zip(texts, flat(found, 0), flat(found, 1), strict=True):
        one, two, x, y = whole(text or "")
        if text and b"".join(x) == b"".join(y) == (" " + text).encode():
            assert (a, b) == (one, two)
        else:
            assert (a, b) == ([], [])


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_pieces_of_any_work_give_the_same_groups(a, b, work):
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    at_a, at_b = alignment.diagonals(a, b, work)
    assert (at_a[0], at_b[0], at_a[-1], at_b[-1]) == (0, 0, len(a), len(b))
    assert (np.diff(at_a) + np.diff(at_b) <= work).all()
    got = alignment.groups(a, b, work)
    both = np.intersect1d(a, b)
    assert got[0].tolist() == (np.searchsorted(a, both) + 1).tolist() and got[1].tolist() == (np.searchsorted(b, both) + 1).tolist()


def test_long_groups_are_linked_in_parts(monkeypatch):
    aligned = alignment.align(["日本 ab the union", "👍🏽👍🏽 a b c the"], ENCODER)
    plain = [x.tolist() for x in alignment.links(aligned, 32_000, 50_257 * 32_000)]
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 2)
    assert [x.tolist() for x in alignment.links(aligned, 32_000, 50_257 * 32_000)] == plain


def test_query_equals_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(alignment, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(alignment, "PIECE_WORK", 100)
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts = [*texts, *ODD, None, texts[0], texts[0], " ".join(texts[:40])]
    docs = spark.createDataFrame([(k if k % 50 else None, t, 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, shard int, key int, n int")
    got = rows(alignment.linked(docs.repartition(3)))
    want = [(k if k % 50 else None, *w) for k, w in enumerate(brute(texts))]
    assert sorted(map(str, got)) == sorted(map(str, want))


class _Here:
    """A table whose ``mapInArrow`` gives its function back, to run tasks in this process as a worker does that is used again."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_tasks_of_a_worker_share_an_encoder_and_leave_no_words(monkeypatch):
    made = []
    monkeypatch.setattr(alignment, "Encoder", lambda files: made.append(ENCODER) or ENCODER)
    monkeypatch.setattr(alignment, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    alignment.worker_encoder.cache_clear()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["words of a task"]})
    for _ in range(3):
        run = alignment.link_shards(_Here(), alignment.Files(FILES.a, FILES.b))
        assert [b.column("n_a")[0].as_py() for b in run(iter([batch]))] == [[len(whole("words of a task")[0])]]
        assert not ENCODER.number
    assert len(made) == 1


def test_shards_are_bounded_by_links_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 1_000)
    many = spark.createDataFrame([(k, f"the reunion {k} of " * 10) for k in range(100)], "doc_id long, text string").coalesce(1)
    wide = spark.createDataFrame([(k, "日本" * 50) for k in range(100)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "SHARD_BYTES", 6_000)  # 300 bytes a text, 100 characters
    assert max(len(r["doc_id"]) for r in alignment.link_shards(wide).collect()) <= 28
    monkeypatch.setattr(alignment, "SHARD_BYTES", 1 << 20)
    monkeypatch.setattr(alignment, "SHARD_LINKS", 100)
    got = alignment.link_shards(many).collect()
    assert sum(len(r["doc_id"]) for r in got) == 100 and max(len(r["times"]) for r in got) < 300


def test_a_row_group_of_shards_is_bounded(spark, monkeypatch):
    written, materialise = [], alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda *a, **b: written.append(materialise(*a, **b)) or written[0])
    monkeypatch.setattr(alignment, "BATCH_BYTES", 1_000)
    monkeypatch.setattr(alignment, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(alignment, "WRITTEN_BYTES", 1_000)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [f"word {k} of the reunion " * 10 for k in range(100)]
    got = alignment.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(str, got)) == sorted(str(Row(**dict(zip(got[0].__fields__, (k, *w), strict=True)))) for k, w in enumerate(brute(texts)))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written[0].inputFiles()]
    assert sum(f.num_rows for f in files) >= 5 and all(f.row_group(k).num_rows == 1 for f in files for k in range(f.num_row_groups))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_alignments_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "the reunion of 日本"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.alignments(docs).collect()}
    assert got[2]["a_ids"] == got[3]["b_ids"] == got[2]["a_ends"] == []
    row, before = got[1], (0, 0)
    for ends in zip(row["a_ends"], row["b_ends"], strict=True):
        one, two = (b"".join(ENCODER.spelled[k][i] for i in ids[s:e]) for k, (ids, s, e) in enumerate(zip((row["a_ids"], row["b_ids"]), before, ends)))
        assert one == two
        before = ends
    assert before == (len(row["a_ids"]), len(row["b_ids"]))


@pytest.mark.parametrize("found", [[], [(None, None)]])
def test_empty_tables(spark, found):
    got = rows(alignment.linked(spark.createDataFrame(found, "doc_id long, text string")))
    assert got == [(None, 0, 0, 0, 0, 0, 0, "")] * len(found)
