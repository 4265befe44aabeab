"""CSV with quoted line breaks, read in as many tasks as its files have splits.

A line break ends a record unless it stands inside quotes, and whether it does depends on all quotes of the file before
it.  So the quotes of each split are counted first; a running sum over the splits of a file tells which splits begin
inside quotes.  Then every split puts its own lines together to records.  What a record has in other splits than the one
it begins in meets it by a shuffle: at most two pieces a split, whatever the file's size.  Spark's own parser cuts records
into fields, so values are those of the one-task reader.

The text is read three times (quotes, records, pieces) and never shuffled but for the pieces.  One row per split is sent
to all tasks: as many rows as the list of splits that Spark's driver holds anyway.

Quotes must be as RFC 4180 has them: around a whole value, doubled inside.  Records end in line feeds; in a file whose
first line ends in carriage return and line feed the two are one line end everywhere, as for the one-task reader.  Files
may have any number of splits; a record may reach over several of them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE = '"'
_BOM = "\ufeff"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without their line feed, with their file and where their split begins."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of each split in a batch; a task reads its splits one after the other."""
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    start = batch.column("start").to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.column("file")[a].as_py(), int(start[a]), batch.slice(a, b - a)


_SPLIT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("closes", pa.bool_()), ("returns", pa.bool_())])


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, whether its quotes are odd, and whether quotes open at its start would close at the end of a line but the last;
    and whether the first line ends in a carriage return."""
    now, odd, closes, last_odd, returns = None, False, False, False, False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "odd": odd, "closes": closes, "returns": returns}], schema=_SPLIT)

    for batch in batches:
        for file, start, rows in _runs(batch):
            if (file, start) != now:
                if now:
                    yield told()
                now, odd, closes, last_odd = (file, start), False, False, False
                returns = rows.column("returns")[0].as_py()
            after = (np.cumsum(rows.column("quotes").to_numpy()) + odd) % 2 == 1
            closes = closes or last_odd or bool(after[:-1].any())
            odd = last_odd = bool(after[-1])
    if now:
        yield told()


def split_table(lines: DataFrame) -> DataFrame:
    """(file, start, inside, owner, returns): does the split begin inside quotes, where does the split begin that such a
    record is from, and does the file's first line end in a carriage return."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counted = lines.select("file", "start", quotes.cast("int").alias("quotes"), F.endswith("value", F.lit("\r")).alias("returns")).mapInArrow(
        _summarised, "file string, start long, odd boolean, closes boolean, returns boolean"
    )
    order = W.partitionBy("file").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    placed = counted.withColumn("inside", inside)
    opens = (F.col("inside") != F.col("odd")) & (~F.col("inside") | F.col("closes"))
    return placed.withColumn("opens", F.when(opens, F.col("start"))).select(
        "file", "start", "inside", F.last("opens", ignorenulls=True).over(before).alias("owner"),
        F.first("returns").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("returns"),
    )


def _joined(lines: list[pa.Array], offsets: Sequence[int]) -> pa.Array:
    """Runs of lines as one text each."""
    flat = pa.concat_arrays([part.cast(pa.string()) for part in lines])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), "\n")


def _check_header(record: str, columns: Sequence[str]) -> None:
    found = next(csv.reader(io.StringIO(record.removeprefix(_BOM).rstrip("\r"), newline="")), [])
    if [name.replace("\r\n", "\n") for name in found] != list(columns):
        raise ValueError(f"the file's header is {found}, not {list(columns)}")


_RECORD = "record string, returns boolean"
_PIECE = "file string, owner long, start long, piece string, returns boolean, header boolean"


def _records(columns: Sequence[str], pieces: bool):
    """Records that lie in one split, or else the pieces of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        open_lines: list[pa.Array] = []  # of a record that has not ended yet
        inside = foreign = header = returns = False  # inside quotes; that record began in another split; it is the file's first
        owner = 0

        def left() -> Iterator[pa.RecordBatch]:
            """The record that is open at the split's end: its rest is elsewhere, unless the file ends."""
            if pieces and open_lines:
                text = _joined(open_lines, [0, sum(map(len, open_lines))])
                yield piece(owner if foreign else now[1], text[0].as_py())

        def piece(of: int, text: str) -> pa.RecordBatch:
            columns = [pa.array([now[0]]), pa.array([of], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([text]), pa.array([returns]), pa.array([header])]
            return pa.RecordBatch.from_arrays(columns, ["file", "owner", "start", "piece", "returns", "header"])

        for batch in batches:
            for file, start, rows in _runs(batch):
                if (file, start) != now:
                    if now:
                        yield from left()
                    now, open_lines = (file, start), []
                    inside = foreign = rows.column("inside")[0].as_py()
                    owner, returns, header = rows.column("owner")[0].as_py(), rows.column("returns")[0].as_py(), start == 0
                values = rows.column("value")
                after = (np.cumsum(rows.column("quotes").to_numpy()) + inside) % 2 == 1
                inside = bool(after[-1])
                ends = np.flatnonzero(~after) + 1
                if not len(ends):
                    open_lines.append(values)
                    continue
                held = sum(map(len, open_lines))
                done = _joined([*open_lines, values.slice(0, ends[-1])], [0, *(ends + held).tolist()])
                open_lines = [values.slice(ends[-1])] if ends[-1] < len(values) else []
                if foreign:
                    if pieces:
                        yield piece(owner, done[0].as_py())
                    done = done[1:]
                elif header and len(done):
                    _check_header(done[0].as_py(), columns)
                    done = done[1:]
                foreign = header = False
                if not pieces and len(done):
                    yield pa.RecordBatch.from_arrays([done.cast(pa.string()), pa.array([returns] * len(done))], ["record", "returns"])
        if now:
            yield from left()

    return run


def csv_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The records below the header of the CSV files at ``path``, each as one text; ``columns`` is what the header must be."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    placed = lines.withColumn("quotes", quotes.cast("int")).join(F.broadcast(split_table(lines)), ["file", "start"])
    whole = placed.mapInArrow(_records(columns, pieces=False), _RECORD)
    cut = placed.mapInArrow(_records(columns, pieces=True), _PIECE)
    in_order = F.array_sort(F.collect_list(F.struct("start", "piece")))
    mended = cut.groupBy("file", "owner").agg(
        F.array_join(F.transform(in_order, lambda p: p["piece"]), "\n").alias("record"), F.first("returns").alias("returns"), F.max("header").alias("header")
    )
    found = whole.unionAll(mended.where("not header").select("record", "returns"))
    plain = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return found.select(F.when(F.col("returns"), plain).otherwise(F.col("record")).alias("record"))


def split_csv(spark: SparkSession, path: str, columns: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Rows of CSV files with a header, every column a string; empty lines are no records."""
    schema = ", ".join(f"`{name}` string" for name in columns)
    found = csv_records(spark, path, columns).where("record != ''")
    return found.select(F.from_csv("record", schema, options).alias("row")).select("row.*")
