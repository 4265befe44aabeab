import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textfacts.operators import ordering as O


def md5(value):
    return hashlib.md5(str(value).encode()).hexdigest()


@pytest.fixture(scope="module")
def dated(spark):
    """2,000 rows, a third of them on one day, some without a date."""
    random.seed(3)
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 13) for d in (1, 9, 17)]
    data = []
    for i in range(2000):
        day = "2020-06-09" if i % 3 == 0 else random.choice([*days, None])
        data.append((i, day, md5(i)))
    df = spark.createDataFrame(data, "id long, day string, key string").repartition(7)
    expected = sorted(data, key=lambda r: (r[1] is None, r[1] or "", r[2]))
    return df, [r[0] for r in expected]


def test_rank_keys_against_a_sort(dated):
    df, order = dated
    ranks = [1, 2, 700, 701, 999, 1333, 1999, 2000]
    keys = O._date_levels(df, "day", "key")
    got = O.rank_keys(keys, [0, *ranks, 2001])
    assert {r: v[-1] for r, v in got.items()} == {r: md5(order[r - 1]) for r in ranks}


@pytest.mark.parametrize("rows", [0, 1, 750, 2000, 5000])
def test_first_by_date(dated, rows):
    df, order = dated
    got = [r["id"] for r in O.first_by_date(df, "day", "key", rows).select("id").collect()]
    assert sorted(got) == sorted(order[:rows])


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("cap", [None, 1500])
def test_positional_split(dated, partitions, cap):
    df, order = dated
    order = order[:cap]
    n_train, n_val, n_test = O.split_sizes(len(order))
    split = O.positional_split(
        df.repartition(partitions), "day", "key", cap, small={"train": 100, "val": 20, "test": 10**6}
    ).collect()
    want = {}
    for place, i in enumerate(order):
        name = "train" if place < n_train else "val" if place < n_train + n_val else "test"
        start = {"train": 0, "val": n_train, "test": n_train + n_val}[name]
        want[i] = (name, place - start < {"train": 100, "val": 20, "test": 10**6}[name])
    assert {r["id"]: (r["split"], r["small"]) for r in split} == want
    assert len(split) == n_train + n_val + n_test


def test_split_of_nothing_and_of_little(spark):
    empty = spark.createDataFrame([], "day string, key string")
    assert O.positional_split(empty, "day", "key").count() == 0
    few = spark.createDataFrame([("2020", md5(i)) for i in range(5)], "day string, key string")
    got = [r["split"] for r in O.positional_split(few, "day", "key").orderBy("key").collect()]
    assert got == ["train"] * 4 + ["test"]


def test_split_sizes():
    assert O.split_sizes(253_930) == (228_537, 12_696, 12_697)
    assert O.split_sizes(0) == (0, 0, 0)


def test_no_task_holds_all_rows(dated):
    """Labelling is a filterless projection of literals: no shuffle, no sort, no join."""
    df, _ = dated
    plan = O.positional_split(df, "day", "key")._jdf.queryExecution().optimizedPlan().toString()
    for operator in ("Window", "Sort", "Join", "Aggregate"):
        assert operator not in plan


@pytest.mark.parametrize("rows", [1, 10, 137, 2000])
def test_take_first(dated, rows):
    df, _ = dated
    got = [r["id"] for r in O.take_first(df, ["id"], rows).select("id").collect()]
    assert sorted(got) == list(range(rows))
    by_two = O.take_first(df.where("day is not null"), ["day", "id"], 5).select("day", "id").collect()
    want = df.where("day is not null").orderBy("day", "id").limit(5).select("day", "id").collect()
    assert sorted(by_two) == sorted(want)


def test_take_first_keeps_null_keys(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, None), (1, "z")], "id long, name string").repartition(3)
    for order, n in ((["id"], 1), (["id", "name"], 2), (["id", "name"], 3)):
        got = sorted(map(tuple, O.take_first(df, order, n).collect()), key=repr)
        assert got == sorted(map(tuple, df.orderBy(*order).limit(n).collect()), key=repr)


@pytest.mark.parametrize("rows", [0, 1, 333, 2000, 4000])
def test_seeded_sample(dated, rows):
    df, _ = dated
    got = {r["id"] for r in O.seeded_sample(df, "id", rows).collect()}
    want = sorted(range(2000), key=lambda i: md5(f"42:{i}"))[:rows]
    assert got == set(want)
    again = {r["id"] for r in O.seeded_sample(df.repartition(3), "id", rows).collect()}
    assert again == got


def test_epochs_have_different_orders(spark):
    df = spark.range(50)
    orders = [
        [r["id"] for r in O.epoch_order(df, "id", e).orderBy("order_key").collect()] for e in (0, 1)
    ]
    assert orders[0] != orders[1]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50))


def test_row_key_tells_rows_apart(spark):
    df = spark.createDataFrame(
        [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("abc", None), ("-", "abc")], "a string, b string"
    )
    assert df.select(F.count_distinct(O.row_key(["a", "b"]))).first()[0] == 6
