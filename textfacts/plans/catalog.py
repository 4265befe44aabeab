"""The registered queries: every operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import factuality as fact
from textfacts.functions import text as T
from textfacts.functions.mentions import NameGrammar
from textfacts.functions.rouge import METRICS, rouge
from textfacts.functions.subwords import decode_subwords, encode_subwords, read_vocabulary
from textfacts.operators import curation, examples, grid, ordering, report, sketches
from textfacts.operators.factuality import (
    GAZETTEER,
    add_features,
    add_source_features,
    consistency_scores,
    loss_parts,
    rounded,
    staged_losses,
    terms_by_category,
)
from textfacts.operators.grouping import concat_documents
from textfacts.plans import views
from textfacts.plans.curation import curated_articles, split_articles
from textfacts.plans.evaluation import evaluate_rows, evaluation_scores, event_samples, run_evaluation
from textfacts.session import TEST_VOCABULARY, materialise, work_path
from textfacts.sources import manifest
from textfacts.sources import results as res
from textfacts.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def listed(values: Column) -> Column:
    """An array as one sorted text, which any engine compares alike."""
    return F.array_join(F.sort_array(values), "|")


# --- scans and sinks -------------------------------------------------------


def _articles_read_back(spark, folder, read):
    path = work_path(spark, "articles-csv")
    raw = views.raw_articles(spark, folder)
    tables.write_articles_csv(raw, path)
    named = curation.standard_columns(read(spark, path, raw.columns))
    return named.select(
        F.md5("article").alias("article_md5"), F.md5("summary").alias("summary_md5"),
        "headline", "category", "date",
    )


@register
def scan_articles_csv(spark, folder):
    """Articles written as CSV with line breaks in them, and read back."""
    return _articles_read_back(spark, folder, tables.articles_csv)


@register
def scan_articles_csv_split(spark, folder):
    """The same read by as many tasks as the files have splits."""
    return _articles_read_back(spark, folder, tables.articles_csv_split)


@register
def scan_capped(spark, folder):
    return tables.capped(tables.scan(spark, folder, "documents"), ["doc_id"])


@register
def write_splits(spark, folder):
    """Curated splits written as one table, and counted after reading it back."""
    path = work_path(spark, "splits")
    tables.write_splits(split_articles(views.raw_articles(spark, folder)), path)
    tables.write_if_absent(spark.range(0), path)  # there already: left alone
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("small").alias("n_small"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


@register
def write_once(spark, folder):
    """Curated splits made as a table by the first of two calls; the second, with other rows, leaves it."""
    path = work_path(spark, "once")
    rows = split_articles(views.raw_articles(spark, folder)).select("split", "small", "date")
    made = [tables.write_if_absent(found, path) for found in (rows, rows.where("small"))]
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("small").alias("n_small"),
        F.lit(made[0] and not made[1]).alias("made_once"),
    )


@register
def read_split(spark, folder):
    path = work_path(spark, "splits")
    tables.write_splits(split_articles(views.raw_articles(spark, folder)), path)
    return tables.read_split(spark, path, "val").select("row_key", "date", "small")


# --- curation --------------------------------------------------------------


@register
def curate_filter_funnel(spark, folder):
    return curation.filter_funnel(views.raw_articles(spark, folder))


@register
def curate_exact_dedup(spark, folder):
    return curation.drop_exact_duplicates(views.documents(spark, folder).select("text", "lang"))


@register
def curate_articles(spark, folder):
    return curation.curate(views.raw_articles(spark, folder)).select(
        "row_key", "headline", "category", "date", "summary_word_count", "article_word_count"
    )


@register
def curate_date_cap(spark, folder):
    return curated_articles(views.raw_articles(spark, folder), cap=C.TEST_ROWS).select("row_key", "date")


@register
def curate_split_positional(spark, folder):
    return split_articles(views.raw_articles(spark, folder)).select("row_key", "date", "split", "small")


@register
def split_orders_by_date(spark, folder):
    orders = tables.scan(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.md5(F.col("o_orderkey").cast("string")).alias("key"),
    )
    return ordering.positional_split(orders, "order_date", "key").select(
        "o_orderkey", "order_date", "split", "small"
    )


@register
def curate_corpus_stats(spark, folder):
    return curation.corpus_statistics(curation.curate(views.raw_articles(spark, folder)))


@register
def curate_day_statistics(spark, folder):
    """Statistics of all days from sketches by day, of which the later ones were added on their own, against exact ones."""
    path = work_path(spark, "day-sketches")
    curated = materialise(curation.curate(views.raw_articles(spark, folder)), "curated")
    for days in (F.col("date") < "2020-07-01", F.col("date") >= "2020-07-01"):
        sketches.store_days(sketches.day_sketches(curated.where(days)), path)
    told = sketches.day_statistics(sketches.read_days(spark, path))
    middle = told.select("q50_article_word_count").scalar()
    words = F.col("article_word_count")
    exact = curated.select("headline", "category", (words < middle).alias("below"), (words <= middle).alias("upto")).agg(
        F.count_distinct("headline").alias("headlines"), F.count_distinct("category").alias("categories"),
        F.avg(F.col("below").cast("int")).alias("below"), F.avg(F.col("upto").cast("int")).alias("upto"),
    )
    return told.select(
        "n", F.round("avg_article_word_count", 6).alias("avg_article_words"), F.round("std_article_word_count", 4).alias("std_article_words"),
        F.round("avg_summary_word_count", 6).alias("avg_summary_words"),
        (F.abs(F.col("different_headline") - exact.select("headlines").scalar()) <= exact.select(F.col("headlines") * 0.05 + 1).scalar()).alias("headlines_agree"),
        (F.col("different_category") == exact.select("categories").scalar()).alias("categories_agree"),
        exact.select((F.col("below") <= 0.54) & (F.col("upto") >= 0.46)).scalar().alias("median_agrees"),
    )


@register
def curate_target_check(spark, folder):
    return curation.check_targets(curate_corpus_stats(spark, folder))


@register
def sample_seeded(spark, folder):
    orders = tables.scan(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return ordering.seeded_sample(orders, "o_orderkey", C.TRAIN_SAMPLE_ROWS)


@register
def epoch_batch_rows(spark, folder):
    """Two shuffled epochs that need no sort: every batch is full and holds its own places."""
    docs = ordering.dense_positions(tables.scan(spark, folder, "documents").select("doc_id"))
    n = docs.count()
    epochs = [ordering.epoch_batches(docs, n, e, 64).select(F.lit(e).alias("epoch"), "batch", "place", "doc_id") for e in (0, 1)]
    return epochs[0].unionByName(epochs[1]).groupBy("epoch", "batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_documents"),
        F.min("place").alias("first_place"), F.max("place").alias("last_place"),
    )


@register
def epoch_shuffle_key(spark, folder):
    docs = tables.scan(spark, folder, "documents").select("doc_id")
    epochs = [ordering.epoch_order(docs, "doc_id", e).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return epochs[0].unionByName(epochs[1])


# --- text ------------------------------------------------------------------


@register
def word_counts(spark, folder):
    return views.documents(spark, folder).select("doc_id", T.word_count("text").alias("n_words"))


@register
def truncate_preview(spark, folder):
    return views.documents(spark, folder).select(
        "doc_id",
        T.preview("text").alias("preview"),
        F.md5(T.truncate_chars("text", C.ARTICLE_CHARS)).alias("article_cut_md5"),
        F.md5(T.truncate_chars("text", C.SEMANTIC_SOURCE_CHARS)).alias("source_cut_md5"),
        F.md5(T.truncate_chars("text", C.SEMANTIC_SUMMARY_CHARS)).alias("summary_cut_md5"),
    )


@register
def slug_names(spark, folder):
    name = F.concat_ws("/", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return tables.scan(spark, folder, "part").select("p_partkey", T.slug(name).alias("slug"))


@register
def model_flags(spark, folder):
    docs = views.documents(spark, folder).select("doc_id", "text")
    return examples.per_model(docs).select(
        "doc_id",
        "model_name",
        T.is_long_context("model_id").alias("long_context"),
        F.length(T.with_prompt("text", "model_id")).alias("n_prompt_chars"),
    )


def _dates(spark, folder, **options):
    return views.noted_documents(spark, folder).select(
        "doc_id", listed(T.date_mentions("text", **options)).alias("dates")
    )


@register
def dates_posthoc(spark, folder):
    return _dates(spark, folder)


@register
def dates_training(spark, folder):
    return _dates(spark, folder, year=T.WORD_YEAR)


@register
def dates_full(spark, folder):
    return _dates(spark, folder, full_dates=True)


@register
def vocab_terms_substring(spark, folder):
    return views.documents(spark, folder).select(
        "doc_id", listed(T.vocabulary_terms("text")).alias("terms")
    )


@register
def vocab_terms_word(spark, folder):
    return views.documents(spark, folder).select(
        "doc_id", listed(T.vocabulary_terms("text", match="word")).alias("terms")
    )


@register
def vocab_by_category(spark, folder):
    found = views.documents(spark, folder).select(T.vocabulary_terms("text").alias("terms"))
    return terms_by_category(found, "terms")


@register
def entity_mentions(spark, folder):
    found = views.noted_documents(spark, folder).select(
        "doc_id", F.explode(T.typed_mentions("text", GAZETTEER)).alias("m")
    )
    return found.groupBy("doc_id", F.col("m.type").alias("type"), F.col("m.text").alias("mention")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register
def entity_names(spark, folder):
    """Persons by their titles, places by their place words, organisations by name."""
    found = views.reported_documents(spark, folder).select(
        "doc_id", F.explode(T.typed_mentions("text", {"ORG": GAZETTEER["ORG"]}, dates=False, grammar=NameGrammar())).alias("m")
    )
    return found.groupBy("doc_id", F.col("m.type").alias("type"), F.col("m.text").alias("mention")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register
def rouge_token_counts(spark, folder):
    return views.documents(spark, folder).select(
        "doc_id", F.size(T.rouge_tokens("text")).alias("n_tokens"),
        F.md5(F.array_join(T.rouge_tokens("text"), " ")).alias("tokens_md5"),
    )


# --- factuality ------------------------------------------------------------


def feature_pairs(spark, folder, *features):
    """Pairs with the features asked for; the article's are made once, before its summaries."""
    docs = add_source_features(views.pair_documents(spark, folder), "text", features=features)
    made = add_features(views.pairs(docs), "candidate", "summary", features=features)
    wanted = [f"{side}_{f}" for f in features for side in ("source", "summary")]
    return made.select("doc_id", "system", "n", *wanted)


def with_similarity(df, spark, folder):
    """Similarities join on narrow rows, after the texts have become scores."""
    return df.join(views.system_similarities(spark, folder), ["doc_id", "system"], "left")


@register
def temporal_consistency(spark, folder):
    return feature_pairs(spark, folder, "dates").select(
        "doc_id", "system",
        fact.temporal_consistency("summary_dates", "source_dates").alias("temporal"),
    )


@register
def hallucinated_dates(spark, folder):
    return feature_pairs(spark, folder, "date_words").select(
        "doc_id", "system",
        fact.invented_date_loss("summary_date_words", "source_date_words").alias("temporal_loss"),
    )


@register
def vocab_preservation(spark, folder):
    loss = fact.term_loss("summary_terms", "source_terms")
    return feature_pairs(spark, folder, "terms").select(
        "doc_id", "system", loss.alias("entity_loss"), (1 - loss).alias("preservation")
    )


@register
def entity_consistency(spark, folder):
    return feature_pairs(spark, folder, "mentions").select(
        "doc_id", "system",
        F.round(fact.entity_consistency("summary_mentions", "source_mentions"), 9).alias("entity"),
    )


@register
def semantic_cosine(spark, folder):
    return views.similarities(spark, folder).select(
        "vec_id",
        F.round("similarity", 6).alias("similarity"),
        F.round(fact.semantic_loss("similarity"), 6).alias("semantic_loss"),
    )


@register
def semantic_flag(spark, folder):
    flagged = views.similarities(spark, folder).select(fact.semantic_flag("similarity").alias("agrees"))
    return flagged.groupBy("agrees").agg(F.count(F.lit(1)).alias("n_pairs"))


CONSISTENCIES = ("entity", "temporal", "semantic", "overall")


def _consistencies(spark, folder):
    features = feature_pairs(spark, folder, "dates", "mentions")
    return consistency_scores(with_similarity(features, spark, folder), "similarity")


@register
def factuality_overall(spark, folder):
    scored = _consistencies(spark, folder)
    return scored.select("doc_id", "system", *[F.round(c, 6).alias(c) for c in CONSISTENCIES])


@register
def factuality_shown(spark, folder):
    """The scores as they are shown."""
    return rounded(_consistencies(spark, folder).select("doc_id", "system", *CONSISTENCIES), CONSISTENCIES)


def _loss_rows(spark, folder, missing_as_zero=True):
    features = with_similarity(feature_pairs(spark, folder, "date_words", "terms"), spark, folder)
    words = F.floor((2 * F.col("n") + 4) / 5)
    share = F.when(F.col("n") > 0, words / F.col("n")).otherwise(0.0)
    return loss_parts(features.withColumn("ce", share), "similarity", missing_as_zero)


@register
def stage_weighted_loss(spark, folder):
    return staged_losses(_loss_rows(spark, folder)).select(
        "doc_id", "system", "stage", F.round("total", 6).alias("total")
    )


@register
def system_factuality(spark, folder):
    """How faithful is each summariser?  Mean scores per system."""
    found = feature_pairs(spark, folder, "dates", "date_words", "terms")
    return found.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.avg(fact.temporal_consistency("summary_dates", "source_dates")), 6).alias("temporal"),
        F.round(F.avg(1 - fact.invented_date_loss("summary_date_words", "source_date_words")), 6).alias("date_truth"),
        F.round(F.avg(1 - fact.term_loss("summary_terms", "source_terms")), 6).alias("preservation"),
    )


@register
def semantic_coverage(spark, folder):
    """How many of a system's summaries have a similarity, and their mean."""
    rows = _loss_rows(spark, folder, missing_as_zero=False)
    return rows.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("semantic").alias("n_compared"),
        F.round(F.avg("semantic"), 6).alias("semantic_loss"),
    )


@register
def system_delta(spark, folder):
    compared = report.system_comparison(
        _loss_rows(spark, folder, missing_as_zero=False), "system",
        {"entity_preservation": "entity", "temporal_consistency": "temporal", "semantic_fidelity": "semantic"},
        baseline="tail", proposed="lead",
    )
    return compared.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "proposed", "points")])


# --- ROUGE and reports -----------------------------------------------------


def scored_pairs(spark, folder, metrics=("rouge1", "rouge2"), stemmed=False):
    """Scores of all pairs; rows without a text to compare keep their status and have no score."""
    reference = F.when(F.col("status") == "ok", F.col("reference"))
    made = views.pairs(views.pair_documents(spark, folder)).withColumn(
        "scores", rouge(reference, "candidate", metrics, stemmed)
    )
    return made.select("doc_id", "lang", "system", "n", "status", *[F.col("scores")[m].alias(m) for m in metrics])


@register
def rouge1(spark, folder):
    return scored_pairs(spark, folder, ("rouge1",)).select("doc_id", "system", F.round("rouge1", 9).alias("rouge1"))


@register
def rouge2(spark, folder):
    return scored_pairs(spark, folder, ("rouge2",)).select("doc_id", "system", F.round("rouge2", 9).alias("rouge2"))


@register
def rougeL(spark, folder):
    return scored_pairs(spark, folder, ("rougeL",)).select("doc_id", "system", F.round("rougeL", 9).alias("rougeL"))


@register
def rouge_stemmed(spark, folder):
    scored = scored_pairs(spark, folder, ("rouge1", "rouge2", "rougeL"), stemmed=True)
    return scored.select("doc_id", "system", *[F.round(m, 9).alias(m) for m in ("rouge1", "rouge2", "rougeL")])


@register
def system_scores(spark, folder):
    made = report.score_summary(scored_pairs(spark, folder), "system", ("rouge1", "rouge2"))
    return made.select("system", *[F.round(c, 6).alias(c) for c in made.columns if c != "system"])


def system_board(spark, folder):
    """Score rows per system, as if every word of the document had taken a second."""
    rows = scored_pairs(spark, folder).groupBy(F.col("system").alias("model_name")).agg(
        F.sum("n").alias("seconds"),
        *report.success_aggregates(),
        *report.score_aggregates(("rouge1", "rouge2")),
    )
    return rows.withColumn("time_hours", report.hours("seconds")).drop("seconds")


BOARD_COLUMNS = (
    "rank", "model_name", "rouge1_mean", "rouge2_mean", "rouge1_std", "rouge2_std", "total_samples",
    "successful_samples", "failed_samples", "success_rate", "time_hours",
)


def _shown(df, *skip):
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in skip]
    )


@register
def leaderboard(spark, folder):
    board = report.with_tier(report.leaderboard(system_board(spark, folder)), selected="middle")
    return _shown(board.select(*BOARD_COLUMNS, "tier", "selected"))


@register
def leaderboard_stats(spark, folder):
    return _shown(report.board_statistics(system_board(spark, folder)))


@register
def best_system(spark, folder):
    best = report.best_model(system_board(spark, folder))
    return _shown(best.select("model_name", "rouge1_mean", "rouge2_mean", "rouge2_std"))


@register
def named_system(spark, folder):
    board = report.named_models(report.leaderboard(system_board(spark, folder)), "mid")
    return _shown(board.select("rank", "model_name", "rouge2_mean", "success_rate"))


@register
def write_leaderboard(spark, folder):
    """The leaderboard's files, read back: CSV, JSON records and the short CSV."""
    path = work_path(spark, "leaderboard")
    board = _shown(report.leaderboard(system_board(spark, folder)).select(*BOARD_COLUMNS))
    short = ["rank", "model_name", "rouge2_mean"]
    res.write_leaderboard(board, path, short)
    schema = board.schema
    as_csv = spark.read.schema(schema).option("header", True).csv(f"{path}/leaderboard_csv")
    as_json = spark.read.schema(schema).json(f"{path}/leaderboard_json")
    as_short = spark.read.schema(board.select(*short).schema).option("header", True).csv(f"{path}/summary_csv")
    files = {"csv": as_csv, "json": as_json, "short_csv": as_short}
    parts = [df.select(F.lit(name).alias("file"), *short) for name, df in files.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register
def domain_shift_drop(spark, folder):
    """Scores on the other languages against those on English, the change in percent."""
    scored = scored_pairs(spark, folder).withColumn("home", F.col("lang") == "en")
    # a few rows, stored so that the texts are scored once for both sides
    means = materialise(scored.groupBy("home", "system").agg(F.avg("rouge2").alias("rouge2")), "means")
    compared = report.against_published(
        means.where(~F.col("home")), means.where("home"), "system", "rouge2"
    )
    return _shown(compared)


# --- model inputs ----------------------------------------------------------


@register
def multidoc_concat(spark, folder):
    docs = tables.scan(spark, folder, "documents")
    joined = concat_documents(docs, "source", "text", ["doc_id"])
    return joined.select(
        "source", "n_documents", T.with_prompt("document", F.lit("t5-base")).alias("document")
    )


VOCABULARY_SIZE = 5000


@register
def vocab_build(spark, folder):
    return examples.build_vocabulary(views.documents(spark, folder), ["text"], VOCABULARY_SIZE)


@register
def encode_pad_mask(spark, folder):
    docs = views.documents(spark, folder)
    vocabulary = examples.vocabulary_list(examples.build_vocabulary(docs, ["text"], VOCABULARY_SIZE))
    lead = grid.lead_summary("text")
    made = examples.training_examples(
        docs.select("doc_id", F.col("text").alias("article"), lead.alias("summary")), vocabulary
    )
    return made.select("doc_id", *[
        F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
        for c in ("input_ids", "attention_mask", "labels")
    ])


@register
def encode_staged(spark, folder):
    """The staged-training variant: no character limit, longer targets, pads kept as labels."""
    docs = views.documents(spark, folder)
    vocabulary = examples.vocabulary_list(examples.build_vocabulary(docs, ["text"], VOCABULARY_SIZE))
    made = examples.training_examples(
        docs.select("doc_id", F.col("text").alias("article"), grid.lead_summary("text").alias("summary")),
        vocabulary, summary_tokens=C.STAGED_SUMMARY_TOKENS, char_limit=None, mask_labels=False, keep_text=True,
    )
    ids = "aggregate({0}, 0L, (a, x) -> a + x)"
    return made.select(
        "doc_id",
        F.md5("article").alias("source_md5"),
        F.expr(ids.format("input_ids")).alias("input_sum"),
        F.expr(ids.format("attention_mask")).alias("n_attended"),
        F.expr(ids.format("labels")).alias("label_sum"),
        F.size("labels").alias("n_labels"),
    )


@register
def encode_subword_ids(spark, folder):
    """Whole texts as subword ids, and what the ids spell."""
    vocabulary = read_vocabulary(TEST_VOCABULARY)
    ids = views.documents(spark, folder).select("doc_id", encode_subwords("text", vocabulary).alias("ids"))
    return ids.select("doc_id", F.md5(decode_subwords("ids", vocabulary)).alias("spelled_md5"))


@register
def encode_joined_ids(spark, folder):
    """Word ids by a join with the vocabulary as a table."""
    docs = views.documents(spark, folder).select("doc_id", examples.example_tokens("text").alias("tokens"))
    vocabulary = examples.build_vocabulary(views.documents(spark, folder), ["text"], VOCABULARY_SIZE)
    made = examples.encode_joined(docs, "doc_id", "tokens", vocabulary)
    return made.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"))


def _model_lengths(spark, folder):
    docs = views.documents(spark, folder).select("doc_id", T.word_count("text").alias("n_tokens"))
    return examples.with_input_lengths(examples.per_model(docs), "n_tokens")


@register
def input_lengths(spark, folder):
    return _model_lengths(spark, folder).select(
        "doc_id", "model_name", F.col("input_length").cast("long").alias("input_length"), "padded_length"
    )


@register
def padding_overhead(spark, folder):
    rows = _model_lengths(spark, folder).withColumn("status", F.lit("ok"))
    return _shown(rows.groupBy("model_name").agg(*report.length_aggregates()))


@register
def batch_padding(spark, folder):
    """What padding costs per model, with batches in key order and by length."""
    made = grid.padded_by_batch(_model_lengths(spark, folder), "input_length", "doc_id")
    overhead = {f"overhead_{kind}": F.round((F.col(f"padded_{kind}") / F.col("tokens") - 1) * 100, 6) for kind in ("in_order", "by_length")}
    return made.withColumns(overhead)


# --- evaluation runs -------------------------------------------------------


@register
def eval_grid_pending(spark, folder):
    docs = tables.scan(spark, folder, "documents").select("doc_id")
    return grid.pending_grid(docs, views.finished_rows(spark, folder), "doc_id").select("model_name", "doc_id")


@register
def eval_merge_results(spark, folder):
    docs = tables.scan(spark, folder, "documents").select("doc_id")
    earlier = views.finished_rows(spark, folder).withColumn("origin", F.lit("earlier"))
    new = examples.per_model(docs).select("doc_id", "model_name", F.lit("new").alias("origin"))
    merged = grid.merge_results(earlier, new, "doc_id")
    return merged.groupBy("model_name", "origin").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def eval_success_rates(spark, folder):
    rows = examples.per_model(grid.with_status(views.samples(spark, folder), "article", "summary"))
    return _shown(rows.groupBy("model_name").agg(*report.success_aggregates()))


@register
def missing_models(spark, folder):
    expected = spark.createDataFrame(list(C.MODELS.items()), "model_name string, model_id string")
    return report.missing_models(expected, views.finished_rows(spark, folder))


@register
def lead_k_summaries(spark, folder):
    return views.documents(spark, folder).select("doc_id", grid.lead_summary("text").alias("summary"))


def first_words(model_id: str):
    """A plug-in summariser: does not know one of the models, and refuses batches with a very short text."""
    if model_id == "unknown":
        raise LookupError(model_id)

    def summarise(texts: list[str]) -> list[str]:
        split = [text.split() for text in texts]
        if any(len(found) < 30 for found in split):
            raise ValueError("text too short")
        return [" ".join(found[:30]) for found in split]

    return summarise


@register
def eval_generate(spark, folder):
    """A plugged-in summariser whose failures, of a row or of a whole model, become rows."""
    model = F.when(F.col("sample_id") % 10 == 3, "unknown").otherwise("plug-in")
    rows = grid.with_status(views.samples(spark, folder), "article", "summary").withColumn("model_id", model)
    made = grid.generate(rows, first_words)
    return made.select("sample_id", "status", "error", F.md5("generated_summary").alias("summary_md5"))


def _resumed(spark, folder, stemmed=False):
    """A run over one language, then a run over everything that does the rest."""
    path = work_path(spark, "predictions")
    everything = views.samples(spark, folder)
    run_evaluation(everything.where("lang = 'en'").drop("lang"), path, stemmed=stemmed)
    return path, run_evaluation(everything.drop("lang"), path, commits=2, stemmed=stemmed)


@register
def eval_resume(spark, folder):
    path, current = _resumed(spark, folder)
    stored = res.all_predictions(spark, path).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_stored"), F.count_distinct("run_id").alias("n_runs")
    )
    scores = current.groupBy("model_name").agg(
        *report.success_aggregates(), *report.score_aggregates(METRICS)
    )
    return _shown(scores.join(stored, "model_name"))


@register
def eval_published(spark, folder):
    """The same two runs over published slices, with a slice between them whose driver died before it was published."""
    path = work_path(spark, "published")
    everything = views.samples(spark, folder)
    run_evaluation(everything.where("lang = 'en'").drop("lang"), path, stemmed=False, published=True)
    lost = grid.expand_pending(grid.pending_models(everything.where("lang = 'fr'").drop("lang"), manifest.published_predictions(spark, path), "sample_id"))
    lost = evaluate_rows(lost.withColumn("n_words", F.lit(1)), metrics=("rouge1",), stemmed=False)
    manifest.write_attempt(lost.withColumn("run_id", F.lit("dead")), path, "dead-0")
    current = run_evaluation(everything.drop("lang"), path, commits=2, stemmed=False, published=True)
    stored = manifest.published_predictions(spark, path).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_stored"), F.count_distinct("run_id").alias("n_runs")
    )
    scores = current.groupBy("model_name").agg(
        *report.success_aggregates(), *report.score_aggregates(METRICS)
    )
    return _shown(scores.join(stored, "model_name"))


@register
def eval_stemmed(spark, folder):
    """Scores of all models as they are published: stemmed, to two places."""
    path = work_path(spark, "predictions")
    results = run_evaluation(views.samples(spark, folder).drop("lang"), path)
    return evaluation_scores(results).drop("evaluation_date")


@register
def eval_events(spark, folder):
    """A run over events of several documents each, and one model's finished rows."""
    documents = views.samples(spark, folder).withColumn("event", F.concat_ws("-", "lang", F.col("sample_id") % 50))
    samples = event_samples(documents, "event", "article", ["sample_id"], "summary")
    path = work_path(spark, "predictions")
    run_evaluation(samples, path, {name: C.MODELS[name] for name in ("T5-Base", "LED-ArXiv")}, metrics=("rouge1",), stemmed=False)
    rows = res.model_predictions(spark, path, "T5-Base", "string").select(
        "sample_id", "status", "article_preview", "input_length", "padded_length",
        F.md5("generated_summary").alias("summary_md5"), F.round("rouge1", 6).alias("rouge1"),
    )
    return rows


@register
def eval_times(spark, folder):
    """Which models were timed: the lead summary is not, a plugged-in one is."""
    samples = views.samples(spark, folder).drop("lang")
    path = work_path(spark, "predictions")
    run_evaluation(samples, path, {"T5-Base": C.MODELS["T5-Base"]}, metrics=("rouge1",), stemmed=False)
    model = {"BART-Base": C.MODELS["BART-Base"]}
    both = run_evaluation(samples, path, model, summarise=first_words, metrics=("rouge1",), stemmed=False)
    scores = report.run_aggregates(both, ("rouge1",))
    return scores.select(
        "model_name",
        F.col("evaluation_time_seconds").isNotNull().alias("timed"),
        (F.col("time_per_sample") > 0).alias("took_time"),
        (F.length("evaluation_date") == 10).alias("dated"),
        "successful_samples",
    )


@register
def eval_score_files(spark, folder):
    """Score files of a run, scanned back, beside the models nothing was written for."""
    _, current = _resumed(spark, folder)
    path = work_path(spark, "scores")
    scores = report.run_aggregates(current.where("model_name != 'mT5-Base'"), METRICS)
    res.write_scores(scores, path)
    found = res.read_scores(spark, path)
    expected = spark.createDataFrame(list(C.MODELS.items()), "model_name string, model_id string")
    lost = report.missing_models(expected, found).select("model_name", F.lit("missing").alias("state"))
    kept = found.select("model_name", "total_samples", "successful_samples", "avg_input_length")
    return lost.unionByName(kept.withColumn("state", F.lit("found")), allowMissingColumns=True)


@register
def eval_run_summary(spark, folder):
    _, current = _resumed(spark, folder)
    scores = report.run_aggregates(current.where("model_name != 'mT5-Base'"), ("rouge1", "rouge2")).select(
        "model_name", "model_id", "total_samples", "successful_samples", "failed_samples"
    )
    expected = spark.createDataFrame(list(C.MODELS.items()), "model_name string, model_id string")
    failed = report.missing_models(expected, scores)
    samples = views.samples(spark, folder).agg(F.count(F.lit(1)).cast("int")).scalar()
    summary = res.run_summary(scores, failed, "2025-01-01", "textfacts", samples)
    return summary.select(
        "experiment_metadata.num_models_evaluated",
        "experiment_metadata.num_models_failed",
        "experiment_metadata.test_samples",
        F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["model_name"], r["successful_samples"])), "|").alias("results"),
        F.array_join("failed_models", "|").alias("failed_models"),
    )


# --- loss logs and checkpoints ---------------------------------------------


def _epochs(spark, folder, mode):
    return _shown(report.epoch_means(views.loss_log(spark, folder), mode=mode))


@register
def loss_epoch_means(spark, folder):
    return _epochs(spark, folder, "zero_filled")


@register
def loss_epoch_means_computed(spark, folder):
    return _epochs(spark, folder, "computed_only")


@register
def loss_due_batches(spark, folder):
    log = views.loss_log(spark, folder)
    due = report.loss_is_due("batch_idx", "stage")
    return log.groupBy("stage").agg(
        F.count_if(due).alias("n_due"), F.count(F.lit(1)).alias("n_batches"),
        F.count_if(due != F.col("computed")).alias("n_disagree"),
    )


@register
def loss_history(spark, folder):
    """A log appended stage by stage and read back."""
    path = work_path(spark, "losses")
    res.append_losses(views.loss_log(spark, folder), path)
    return _shown(res.read_losses(spark, path).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("total").alias("total_mean")
    ))


@register
def latest_checkpoint(spark, folder):
    paths = tables.scan(spark, folder, "events").select(
        "user_id", F.concat(F.lit("run/checkpoint-"), F.col("event_id")).alias("path")
    )
    return report.latest_checkpoint(paths, "path", ["user_id"])
