import numpy as np
import pytest
from pyspark.sql import functions as F

from textfacts.llm import neighbours


def slow(ids, vectors, queries, k):
    out = {}
    for q in queries:
        score = np.cumsum(vectors * vectors[q], axis=1)[:, -1]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score)) if i != q][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    want = slow(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    got = found(neighbours.op6_neighbours(spark, folder))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.92 * 20 * len(want)


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 3)])
def test_few_vectors_are_all_verified(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[1])
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((90, 6)) * draw.random((90, 1)) * 10
    vectors[[5, 17, 44, 80]] = vectors[3]  # ties
    data = [(i, v) for i, v in enumerate(vectors.tolist())]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "size": F.lit(1)}).repartition(3)
    got = found(neighbours.nearest(table, F.col("vec_id") % 9 == 0, 8))
    assert got == slow(np.arange(90), vectors, range(0, 90, 9), 8)


def test_rows_that_take_no_part(spark):
    good = [(20, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [-1.0, 0.0]), (2, [3.0, 0.0])]
    odd = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (None, [9.0, 9.0]), (9, [1.0, 2.0, 3.0]), (40, [0.0, 0.0])]
    table = spark.createDataFrame(good + odd + good[:1], "vec_id long, embedding array<float>")
    got = found(neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20))
    assert got == {20: [(1, 0.5), (2, -1.0)]}  # of equal ids the smallest vector counts


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).count() == 0
    alone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(alone, F.col("vec_id") % 20 == 0, 20).count() == 0


def test_a_common_vector_ties_by_id(spark):
    draw = np.random.default_rng(5)
    common = draw.standard_normal(16)
    vectors = np.where((np.arange(900) % 3 == 0)[:, None], common, draw.standard_normal((900, 16)))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(table, F.col("vec_id") == 60, 20))
    assert [i for i, _ in got[60]] == [i for i in range(0, 66, 3) if i != 60][:20]


def recall_of(spark, vectors, asked=100, k=20):
    n = len(vectors)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(table, F.col("vec_id") % (n // asked) == 0, k))
    want = slow(np.arange(n), vectors, range(0, n, n // asked), k)
    assert got.keys() == want.keys() and all(len(v) == k for v in got.values())
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / k for q in want])


def test_recall_with_unequal_norms(spark):
    draw = np.random.default_rng(6)
    unit = draw.standard_normal((4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    outlier = unit.copy()
    outlier[1] *= 5
    assert recall_of(spark, outlier) >= 0.92
    assert recall_of(spark, outlier * draw.lognormal(0, 0.5, (4000, 1))) >= 0.92


def test_bands_with_few_rows_share_a_block(monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 1000)
    counts = {-9: 3, -8: 250, -7: 8, 0: 2500, 4: 200, 9: 60}
    assert neighbours.band_blocks(counts, 20) == {-9: (0, 1), -8: (0, 1), -7: (1, 1), 0: (2, 3), 4: (5, 1), 9: (5, 1)}
    assert neighbours.band_blocks({}, 20) == {}
