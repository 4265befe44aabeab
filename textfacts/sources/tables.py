"""Table scans."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.operators.ordering import take_first
from textfacts.sources.records import split_csv


NULL_MARK = "\\N"  # how written CSV files show a missing value


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def capped(df: DataFrame, order: list[str], rows: int = C.TEST_ROWS) -> DataFrame:
    """The first ``rows`` rows in key order."""
    return take_first(df, order, rows)


_READ_CSV = {"escape": '"', "emptyValue": "", "nullValue": NULL_MARK, "multiLine": "true", "maxCharsPerColumn": "-1"}


def articles_csv_split(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Like :func:`articles_csv`, for large files: a file is read by as many tasks as it has splits.

    See :mod:`textfacts.sources.records` for how records are told apart.
    """
    return split_csv(spark, path, columns, _READ_CSV)


def articles_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Article CSV with a header and quoted multi-line text, every column a string.

    The schema is given, never inferred: a file is read once.  Values are kept
    as written, so empty strings stay apart from missing values.  Quoted line
    breaks keep a file from being split, so one file is one task: read large
    exports with :func:`articles_csv_split`.
    """
    schema = ", ".join(f"`{name}` string" for name in columns)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", NULL_MARK)
        .option("enforceSchema", False)
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )


_CSV = {
    "header": True,
    "escape": '"',
    "quoteAll": True,
    "emptyValue": "",
    "nullValue": NULL_MARK,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_articles_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV that :func:`articles_csv` reads back unchanged, line breaks included."""
    texts = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    texts.write.mode(mode).options(**_CSV).csv(path)


def write_splits(
    df: DataFrame, path: str, mode: str = "errorifexists", as_csv: bool = False
) -> None:
    """One table with a folder per split; small splits are a flag column in it.

    Parquet, or CSV files for tools that want those.
    """
    out = df.write.mode(mode).partitionBy("split")
    if as_csv:
        out.options(**_CSV).csv(path)
    else:
        out.parquet(path)


def read_split(spark: SparkSession, path: str, split: str, small: bool = False) -> DataFrame:
    """One split; only that split's folder is read."""
    found = spark.read.parquet(path).where(F.col("split") == split)
    return found.where("small") if small else found


def write_if_absent(df: DataFrame, path: str) -> bool:
    """Make a table once; a later call leaves what is there.  True if this call made it.

    The rows are written beside ``path`` and the finished folder is renamed, which the file system does for one of several
    racing calls only; the others remove what they wrote.  A call that dies leaves a folder named ``<path>.attempt-...``
    that no reader looks at.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).makeQualified(target).toUri(), conf)
    if files.util().exists(target):
        return False
    written = f"{path.rstrip('/')}.attempt-{uuid.uuid4().hex}"
    df.write.parquet(written)
    attempt = jvm.org.apache.hadoop.fs.Path(written)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    keep_what_is_there = spark.sparkContext._gateway.new_array(rename, 1)
    keep_what_is_there[0] = rename.NONE
    try:
        files.rename(attempt, target, keep_what_is_there)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
            raise
        files.delete(attempt, True)
        return False
    return True
