"""Exact positions without a global sort of the rows.

Heads, fixed-size samples and positional splits all come down to a few order
statistics: the sort key at rank r.  Those keys are found from histograms of
narrow key columns, and rows are then labelled by comparing their key with
literals.  No row of text is shuffled, and no task ever orders the rows or
values of one date: keys are narrowed down a few characters at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textfacts import constants as C

_STEP_CHARS = 3  # 4,096 values of a hash, a thousand of a number
_MERGE_GROUPS = 256


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _matches(names: Sequence[str], values: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) == F.lit(v) for n, v in zip(names, values)], F.lit(True))


def rank_keys(keys: DataFrame, ranks: Sequence[int]) -> dict[int, tuple[str, ...]]:
    """Key values at the given 1-based ranks, ordering by all columns in turn.

    ``keys`` holds string columns, no two rows alike.  A column is narrowed
    down a few characters at a time: counts by those characters, taken only
    inside what holds a wanted rank, tell which of them hold it, until one
    value is left.  So no task ever orders more than the few characters'
    values, however many rows or values a day has.  Each step is one
    aggregation that hands one row per wanted rank to the driver.  Ranks below
    1 or past the end are left out.
    """
    open_ranks = {r: ((), "", r) for r in ranks if r >= 1}
    found = {}
    while open_ranks:
        depth, size = min((len(values), len(head)) for values, head, _ in open_ranks.values())
        now = {r: s for r, s in open_ranks.items() if (len(s[0]), len(s[1])) == (depth, size)}
        narrowed = _narrowed(keys, depth, size, now)
        open_ranks = {r: s for r, s in {**open_ranks, **narrowed}.items() if r not in now or r in narrowed}
        found |= {r: s[0] for r, s in open_ranks.items() if len(s[0]) == len(keys.columns)}
        open_ranks = {r: s for r, s in open_ranks.items() if r not in found}
    return found


def _narrowed(keys: DataFrame, depth: int, size: int, open_ranks: dict) -> dict:
    """States (values of whole columns, first characters of the next, rank inside them) one step on."""
    whole, level = keys.columns[:depth], F.col(keys.columns[depth])
    names = [*whole, "head"]
    wanted = sorted({(*values, head) for values, head, _ in open_ranks.values()})
    cut = keys.select(*whole, level.alias("value"), F.substring(level, 1, size).alias("head"))
    counts = (
        cut.where(_any([_matches(names, w) for w in wanted]))
        .groupBy(*names, F.substring("value", 1, size + _STEP_CHARS).alias("part"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    running = W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("rows").over(running))
    holds = [
        _matches(names, w) & (F.col("upto") >= left) & (F.col("upto") - F.col("rows") < left)
        for w, left in sorted({((*values, head), left) for values, head, left in open_ranks.values()})
    ]
    states = {}
    for row in counts.where(_any(holds)).collect():
        before = row["upto"] - row["rows"]
        for rank, (values, head, left) in open_ranks.items():
            if tuple(row[n] for n in names) == (*values, head) and before < left <= row["upto"]:
                one = row["low"] == row["high"]
                states[rank] = ((*values, row["low"]), "", left - before) if one else (values, row["part"], left - before)
    return states


def date_key(date: Column | str) -> Column:
    """Sortable text for a date string, missing dates last."""
    date = F.col(date) if isinstance(date, str) else date
    return F.coalesce(F.concat(F.lit("0"), date), F.lit("1"))


def row_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the given columns, each with its length so that no two rows read alike."""
    parts = []
    for name in columns:
        text = F.col(f"`{name}`").cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*parts), 256)


def _date_levels(df: DataFrame, date: str, tie_break: str) -> DataFrame:
    return df.select(date_key(date).alias("date"), F.col(tie_break).alias("key"))


def _up_to(date: str, tie_break: str, cut: tuple[str, ...] | None) -> Column:
    """Is the row at or before the cut key?  No cut means no row is."""
    if cut is None:
        return F.lit(False)
    cut_date, cut_key = cut
    here = date_key(date)
    return (here < cut_date) | ((here == cut_date) & (F.col(tie_break) <= cut_key))


def first_by_date(df: DataFrame, date: str, tie_break: str, rows: int) -> DataFrame:
    """The first ``rows`` rows by date, missing dates last, then hashed key.

    ``df`` should be a table, not a long plan: its key columns are read a few
    times over.
    """
    cut = rank_keys(_date_levels(df, date, tie_break), [rows]).get(rows)
    return df if cut is None and rows > 0 else df.where(_up_to(date, tie_break, cut))


def split_sizes(
    rows: int, train: float = C.TRAIN_FRACTION, validation: float = C.VALIDATION_FRACTION
) -> tuple[int, int, int]:
    """Train and validation sizes cut down to whole rows; the rest is for testing."""
    n_train, n_val = int(train * rows), int(validation * rows)
    return n_train, n_val, rows - n_train - n_val


def positional_split(
    df: DataFrame,
    date: str,
    tie_break: str,
    cap: int | None = None,
    small: dict[str, int] = C.SMALL_SPLIT_ROWS,
) -> DataFrame:
    """Add ``split`` (train, val, test by position in date order) and ``small``.

    ``small`` marks the first rows of each split.  With ``cap`` only the first
    ``cap`` rows by date take part.  The tie-break must be a unique text key of
    evenly spread values, such as a hash.
    """
    total = df.count()
    if cap is not None:
        total = min(total, cap)
    n_train, n_val, _ = split_sizes(total)
    starts = {"train": 0, "val": n_train, "test": n_train + n_val}
    ends = {"train": n_train, "val": n_train + n_val, "test": total}
    small_ends = {s: min(starts[s] + small[s], ends[s]) for s in starts}
    cuts = rank_keys(
        _date_levels(df, date, tie_break), sorted({*ends.values(), *small_ends.values()})
    )

    def upto(rank: int) -> Column:
        return _up_to(date, tie_break, cuts.get(rank))

    split = F.when(upto(ends["train"]), "train").when(upto(ends["val"]), "val").otherwise("test")
    is_small = reduce(
        lambda a, b: a | b,
        [(F.col("split") == s) & upto(small_ends[s]) for s in starts],
    )
    kept = df if cap is None else df.where(upto(ends["test"]))
    return kept.withColumn("split", split).withColumn("small", is_small)


def take_first(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """The first ``rows`` rows in the order of unique key columns.

    Only key columns are sorted; whole rows are kept by their key.  Each input partition hands on ``rows`` keys at
    most, and those meet in a fixed number of groups before the last sort, so
    no task sees the keys of all partitions.  For small ``rows``.
    """
    near = W.partitionBy("_group").orderBy(*order)
    keys = (
        df.select(*order)
        .withColumn("_group", F.spark_partition_id() % _MERGE_GROUPS)
        .withColumn("_place", F.row_number().over(near))
        .where(F.col("_place") <= rows)
    )
    # the place of a key among the wanted ones decides, so null keys, which sort first, are kept like any other
    wanted = keys.orderBy(*order).limit(rows).select(*[F.col(c).alias(f"_{c}") for c in order])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order])
    return df.join(wanted, same, "left_semi")


def shuffle_key(id_column: str, *seeds: int) -> Column:
    """Repeatable random order: the MD5 of the seeds and the id."""
    parts = [F.lit(str(s)) for s in seeds] + [F.col(id_column).cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def seeded_sample(df: DataFrame, id_column: str, rows: int, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Exactly ``rows`` rows without replacement, the same for any partitioning."""
    keys = df.select(shuffle_key(id_column, seed).alias("key"))
    cut = rank_keys(keys, [rows]).get(rows)
    if cut is None:
        return df if rows > 0 else df.where(F.lit(False))
    return df.where(shuffle_key(id_column, seed) <= cut[-1])


def epoch_order(df: DataFrame, id_column: str, epoch: int, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Rows with the sort key ``order_key`` of one epoch's shuffle."""
    return df.withColumn("order_key", shuffle_key(id_column, seed, epoch))


ROUNDS = 64


def _exchanged(place: Column, n: Column, keys: Column) -> Column:
    """Rounds that each either keep a place or swap it with its partner, whichever a coin of the two says.

    A round is its own inverse on any number of places, so the rounds in the other order undo them.
    """

    def turn(x: Column, key: Column) -> Column:
        partner = F.pmod(F.pmod(key, n) - x + n, n)
        coin = F.xxhash64(key, F.greatest(x, partner)) % 2 == 0
        return F.when(coin, partner).otherwise(x)

    return F.aggregate(keys, place, turn)


def _round_keys(epoch: int, seed: int, backwards: bool) -> Column:
    rounds = range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS)
    return F.array(*[F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(r)) for r in rounds])


def shuffled_place(position: Column | str, n: int, epoch: int, seed: int = C.SAMPLE_SEED) -> Column:
    """Where in an epoch the row at a dense position (0 to n - 1) comes: a permutation for every n, epoch and seed.

    A place is told from the position alone; nothing is sorted or shuffled.
    """
    at = F.col(position) if isinstance(position, str) else position
    size = F.lit(n).cast("long")
    return _exchanged(at.cast("long"), size, _round_keys(epoch, seed, backwards=False))


def position_at(place: Column | str, n: int, epoch: int, seed: int = C.SAMPLE_SEED) -> Column:
    """The position of the row that comes at a place: the inverse of :func:`shuffled_place`."""
    at = F.col(place) if isinstance(place, str) else place
    size = F.lit(n).cast("long")
    return _exchanged(at.cast("long"), size, _round_keys(epoch, seed, backwards=True))


def dense_positions(rows: DataFrame) -> DataFrame:
    """Rows scanned from Parquet files with their ``position`` among all rows, from 0, however the files are split.

    Positions are files in path order and rows in file order.  Counting rows reads no columns; one row per file, with the
    number of rows in the files before it, is what every task gets.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    starts = counts.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_file").withColumn("position", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def epoch_batches(placed: DataFrame, n: int, epoch: int, size: int, first: int = 0, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Rows with their ``place`` in an epoch and ``batch``, from batch ``first`` on: a run goes on where it stopped."""
    made = placed.withColumn("place", shuffled_place("position", n, epoch, seed)).withColumn("batch", F.floor(F.col("place") / size))
    return made.where(F.col("batch") >= first)


def epoch_batch(placed: DataFrame, n: int, epoch: int, size: int, batch: int, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """One batch, in its order: its positions are computed from its places, so rows are picked by literals.

    A batch is small enough for one task by its nature.
    """
    spark = placed.sparkSession
    places = spark.range(batch * size, min((batch + 1) * size, n), 1, 1).select(position_at("id", n, epoch, seed).alias("position"))
    wanted = [r["position"] for r in places.collect()]  # as many as a batch has rows
    found = placed.where(F.col("position").isin(wanted))
    return found.withColumn("place", shuffled_place("position", n, epoch, seed)).orderBy("place")
