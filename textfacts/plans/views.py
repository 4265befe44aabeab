"""Inputs derived from the test tables, over all of their rows and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import text as T
from textfacts.functions.vectors import cosine
from textfacts.operators.columns import with_columns_once
from textfacts.operators.grid import with_status
from textfacts.sources.tables import scan

#: How far from its own id a system's summary looks for the vector it is compared by.
SYSTEM_SHIFTS = {"lead": 1, "middle": 2, "tail": 3, "borrowed": 4}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents")


def with_words(df: DataFrame) -> DataFrame:
    """Add the words ``w`` of ``text`` and their number ``n``."""
    return with_columns_once(df, {"w": T.words("text")}).withColumn("n", F.size("w"))


def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Raw article rows as a news export has them: untidy headers, nulls, copies.

    Nothing in a row depends on the document's id, so copied texts are copied rows.
    """
    split = with_words(documents(spark, folder).select("text", "lang"))
    summary = F.array_join(F.slice("w", F.lit(1), F.expr("cast((3 * n) div 5 as int)")), " ")
    headline = F.array_join(F.slice("w", F.lit(1), F.expr("2 + n % 3")), " ")
    made = with_columns_once(split, {"human_summary": summary, "headline": headline})
    return made.select(
        F.col("text").alias(" article_text"),
        F.col("human_summary").alias("human_summary "),
        F.when(F.length("text") % 50 != 0, F.col("headline")).alias("head\nline"),
        F.col("lang").alias("news_category"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.expr("(n * 7) % 365")), "yyyy-MM-dd").alias("published_date"),
    )


def note(first: Column, second: Column, terms: Column) -> Column:
    """A sentence with dates in every written form and vocabulary terms, all told by three numbers."""

    def number(key: Column, size: int, start: int) -> Column:
        return (F.pmod(key, F.lit(size)) + start).cast("string")

    def pick(values, key: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))

    parts = [
        "Dated ", number(first, 28, 1), "/", number(first, 12, 1), "/", number(first, 30, 1990),
        " and ", pick(C.MONTHS, second), " ", number(second, 27, 1), ", ", number(second, 40, 1980),
        " and ", number(second, 26, 1), " ", pick(C.MONTHS, second + 1), " ", number(second, 50, 1970),
        ", ", pick(C.VOCABULARY["titles"], terms), " of ", pick(C.VOCABULARY["political"], terms + 3),
        " in ", pick(C.VOCABULARY["admin"], terms), " gave ", pick(C.VOCABULARY["numbers"], terms), ".",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Example names for texts that have any.
GIVEN_NAMES = ("Anil", "Priya", "Rahul", "Meera", "Vikram", "Sunita", "Arjun")
FAMILY_NAMES = ("Kumar", "Sharma", "Patel", "Reddy", "Das")
PLACES = ("Pune", "Rampur", "Nagpur", "Lakhanpur", "Anand Nagar", "Kota")


def report(key: Column) -> Column:
    """A sentence or two with persons, organisations and places, and titles and place words that name nobody."""

    def pick(values, step: int) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key + step, F.lit(len(values))) + 1).cast("int"))

    titles, admin = C.VOCABULARY["titles"], C.VOCABULARY["admin"]
    parts = [
        "Yesterday ", pick(titles, 0), " ", pick(GIVEN_NAMES, 0), " ", pick(FAMILY_NAMES, 1), " met the ",
        pick(C.VOCABULARY["political"], 2), " near ", pick(PLACES, 0), " ", pick(admin, 1), ". ",
        pick(admin, 3), " ", pick(PLACES, 4), " told a ", pick(titles, 5), " and ", F.lower(pick(titles, 7)), " ", pick(GIVEN_NAMES, 3), ".",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def reported_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a report behind the text: the corpus itself names nobody."""
    return documents(spark, folder).select("doc_id", F.concat_ws(" ", "text", report(F.col("doc_id"))).alias("text"))


def noted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as ``body``, and ``text``: the body and a note.

    The corpus itself holds few dates and terms; the note gives every document some.
    """
    key = F.col("doc_id")
    docs = documents(spark, folder).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("body"))
    return docs.withColumn("text", F.concat_ws(" ", "body", note(key, key, key)))


def pair_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Noted documents with the next document's text as ``other``."""
    # the test tables are one file each, which one task reads: deal them to as many as a shuffle has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    following = documents(spark, folder).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    noted = noted_documents(spark, folder).repartition(parts, "doc_id")
    joined = noted.join(following.repartition(parts, "doc_id"), "doc_id", "left")
    return joined.withColumn("other", F.coalesce("other", F.lit("")))


def pairs(df: DataFrame) -> DataFrame:
    """(document, system) rows with ``reference`` (the body's first three fifths) and ``candidate``.

    Each system picks two fifths of the words: the first, a middle stretch that starts after three tenths, the last
    ones, or the first of another document.  Notes follow that agree with the document's own wholly, in some dates, in
    some terms, but for the case of the letters, or not at all; every fourth first stretch has none.  ``n`` counts the
    body's words, ``error`` tells rows without a text to compare.
    """
    size = "cast((2 * n + 4) div 5 as int)"
    key = F.col("doc_id")

    def stretch(start: str, words: str = "w", count: str = size) -> Column:
        return F.array_join(F.slice(words, F.greatest(F.expr(start), F.lit(1)), F.expr(count)), " ")

    notes = {
        "lead": F.when(key % 4 != 0, note(key, key, key)),
        "middle": note(key, key + 1, key),
        "tail": F.when(key % 3 == 0, F.upper(note(key, key, key))).otherwise(note(key + 1, key, key + 1)),
        "borrowed": note(key + 2, key + 28, key + 2),
    }
    stretches = {
        "lead": stretch("1"),
        "middle": stretch("cast((3 * n) div 10 as int) + 1"),
        "tail": stretch(f"n - {size} + 1"),
        "borrowed": stretch("1", "v", "cast((2 * size(v) + 4) div 5 as int)"),
    }
    split = with_columns_once(df, {"w": T.words("body"), "v": T.words("other")}).withColumn("n", F.size("w"))
    reference = F.array_join(F.slice("w", F.lit(1), F.expr("cast((3 * n + 4) div 5 as int)")), " ")
    kept = [c for c in df.columns if c not in ("body", "other")]
    # texts are put together once a document; words stay below the systems, which would repeat them
    cut = split.select(*kept, "n", reference.alias("reference"), *[stretches[s].alias(f"_{s}") for s in SYSTEM_SHIFTS])
    made = F.array(
        *[
            F.struct(F.lit(s).alias("system"), F.col(f"_{s}").alias("picked"), F.concat_ws(" ", f"_{s}", notes[s]).alias("candidate"))
            for s in SYSTEM_SHIFTS
        ]
    )
    rows = cut.select(*kept, "n", "reference", F.inline(made))
    return with_status(rows, "picked", "reference").drop("picked")


def similarities(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each embedding with the one of the next id, keyed by the first's id; null without a next one."""
    vectors = scan(spark, folder, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(other, "vec_id", "left").select("vec_id", cosine("embedding", "other").alias("similarity"))


def system_similarities(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, system, similarity): the document's vector against another one for every system."""
    vectors = scan(spark, folder, "embeddings")
    shifts = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("shift")) for s, k in SYSTEM_SHIFTS.items()])
    other = vectors.select("vec_id", F.col("embedding").alias("other"), F.inline(shifts))
    other = other.select((F.col("vec_id") - F.col("shift")).alias("vec_id"), "system", "other")
    return vectors.join(other, "vec_id").select(
        F.col("vec_id").alias("doc_id"), "system", cosine("embedding", "other").alias("similarity")
    )


def loss_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a training log: the type is the stage, the day the epoch."""
    events = scan(spark, folder, "events")
    stage = F.when(F.col("event_type") == "view", "warmup").otherwise(F.col("event_type"))
    # what the run says it computed: by the last digit of the id, and it forgot every user of a multiple of 50
    due = F.col("event_id").cast("string").endswith("0") & (F.col("event_type") != "view") & (F.col("user_id") % 50 != 0)

    def part(column: str, steps: int):
        return F.when(due, (F.col(column) % steps) / steps).otherwise(0.0)

    log = events.select(
        stage.alias("stage"),
        F.day("ts").alias("epoch"),
        F.col("event_id").alias("batch_idx"),
        due.alias("computed"),
        F.col("value").alias("ce"),
        part("user_id", 10).alias("entity"),
        part("user_id", 4).alias("temporal"),
        part("event_id", 7).alias("semantic"),
    )
    total = F.when(
        F.col("computed"),
        0.4 * F.col("ce") + 0.2 * F.col("entity") + 0.2 * F.col("temporal") + 0.2 * F.col("semantic"),
    ).otherwise(F.col("ce"))
    return log.withColumn("total", total)


def finished_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(model_name, doc_id) pairs an earlier run finished, read off the label table."""
    labels = scan(spark, folder, "labels")
    models = F.array_compact(
        F.array(
            F.lit("LED-ArXiv"),
            F.when(F.col("quality") == 1, "BART-Base"),
            F.when(F.col("toxic") == 1, "T5-Base"),
        )
    )
    return labels.select("doc_id", F.explode(models).alias("model_name"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as evaluation samples; the last seven words are the reference.

    Texts whose length is a multiple of 50 have no reference, so that runs
    meet failing rows.
    """
    tail = F.array_join(F.slice("w", F.expr("greatest(n - 6, 1)"), F.lit(7)), " ")
    return with_words(documents(spark, folder)).select(
        F.col("doc_id").alias("sample_id"),
        "lang",
        F.col("text").alias("article"),
        F.when(F.length("text") % 50 != 0, tail).alias("summary"),
    )
