import hashlib
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from textfacts.llm import passages
from textfacts.llm.suffixes import common_prefixes, suffix_array


def slow(data):
    """Every string of 100 bytes, one by one."""
    seen, out = set(), []
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60):
    draw = random.Random(seed)
    words = ["the", "and", "thed", "er", "ingé", "onth", "ststst", "\n"]
    phrases = [" ".join(draw.choices(words, k=draw.randrange(15, 90))) for _ in range(6)]
    data = []
    for i in range(n):
        parts = [" ".join(draw.choices(words, k=draw.randrange(0, 30)))]
        parts += [draw.choice(phrases) + draw.choice(["", "x", " tail"]) for _ in range(draw.randrange(0, 4))]
        if draw.random() < 0.2:
            parts.append(draw.choice(["ab ", "a", "thshorhe "]) * draw.randrange(1, 60))
        data.append((i, " ".join(parts)))
    return data + [(n, data[3][1]), (n + 1, data[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "short")]


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 1), (3, 3)])
def test_same_bytes_as_one_by_one(spark, monkeypatch, seed, hot):
    for name, size in (("SHARD_BYTES", 20_000), ("BUCKET_BYTES", 30_000), ("OPEN_BYTES", 30_000), ("HOT", hot)):
        monkeypatch.setattr(passages, name, size)
    data = made(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(rows(passages.repeats(docs)), key=repr) == slow(data)


def test_query_is_what_one_by_one_gives(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert sorted(rows(passages.op10_passages(spark, folder)), key=repr) == slow(rows(docs))


def test_null_ids_come_first_and_other_columns_stay(spark):
    text = "".join(random.Random(6).choices("abcdefgh ", k=150))
    data = [(5, text + "é", "a"), (None, text, "b"), (7, None, "c"), (7, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string").withColumn("payload", F.lit(1)).repartition(2)
    got = passages.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(rows(got), key=repr) == sorted([(5, "é", "a", 1), (None, text, "b", 1), (7, None, "c", 1), (7, "", None, 1)], key=repr)


def test_repeated_rows_are_documents_of_their_own(spark):
    text = "".join(random.Random(7).choices("abcdefgh ", k=130))
    docs = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string").repartition(2)
    assert sorted(r["n_removed"] for r in passages.repeats(docs).collect()) == [0, 130, 130]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeats(docs).count() == 0
    assert passages.without_repeats(docs).count() == 0


def test_very_long_text(spark):
    text = "".join(random.Random(5).choices("abcdefgh ", k=300_000))
    docs = spark.createDataFrame([(1, text), (2, text[1000:250_000]), (3, "x" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in passages.repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (249_000, 1), 3: (199_999, 1)}


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays_and_common_prefixes(seed):
    draw = np.random.default_rng(seed)
    raw = draw.integers(97, 97 + int(draw.integers(1, 4)), int(draw.integers(1, 300))).astype(np.uint8)
    raw = np.concatenate([raw, raw[: len(raw) // 2], raw])
    raw[draw.integers(0, len(raw), 2)] = 0
    text, depth = raw.tobytes(), int(draw.choice([8, 20, 100]))
    order = suffix_array(raw, depth)
    heads = [text[i : i + depth] for i in order]
    assert sorted(order) == list(range(len(raw))) and heads == sorted(heads)
    shared = common_prefixes(raw, order, depth, np.arange(0, len(raw), 50))
    for a, b, n in zip(heads, heads[1:], shared[1:], strict=False):
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == same
