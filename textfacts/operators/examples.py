"""Model inputs from articles: vocabulary, token ids, masks, input lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textfacts import constants as C
from textfacts.functions import encoding as E
from textfacts.functions import text as T
from textfacts.functions.subwords import encode_subwords


def example_tokens(text: Column | str, char_limit: int | None = None) -> Column:
    """Lower-cased words, of the first ``char_limit`` characters if one is set."""
    text = F.col(text) if isinstance(text, str) else text
    return T.words(F.lower(text if char_limit is None else T.truncate_chars(text, char_limit)))


def build_vocabulary(df: DataFrame, texts: Sequence[str], size: int) -> DataFrame:
    """The ``size`` most frequent words with counts and token ids.

    Counts are combined before the shuffle, so a very frequent word costs one
    row per input partition.  Ties go to the word that sorts first.
    """
    exploded = df.select(F.explode(F.concat(*[F.coalesce(example_tokens(t), F.array().cast("array<string>")) for t in texts])).alias("token"))
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    # at most ``size`` rows are numbered
    rank = F.row_number().over(W.orderBy(F.desc("n"), "token"))
    return top.withColumn("token_id", rank + F.lit(E.FIRST_TOKEN_ID - 1))


def vocabulary_list(vocabulary: DataFrame) -> list[str]:
    """Tokens in id order; no more than the size the vocabulary was built with."""
    return [row["token"] for row in vocabulary.orderBy("token_id").select("token").collect()]


def training_examples(
    df: DataFrame,
    vocabulary: Sequence[str] | None,
    article: str = "article",
    summary: str = "summary",
    article_tokens: int = C.ARTICLE_TOKENS,
    summary_tokens: int = C.SUMMARY_TOKENS,
    char_limit: int | None = C.ARTICLE_CHARS,
    mask_labels: bool = True,
    keep_text: bool = False,
    subwords: str | None = None,
) -> DataFrame:
    """Fixed-length ``input_ids``, ``attention_mask`` and ``labels``.

    Words past the token limit are cut before they are looked up.
    ``mask_labels`` hides pads from the loss; the staged training variant keeps
    them, takes 256 summary tokens, no character limit, and keeps the texts.
    With ``subwords``, the text of a byte-pair vocabulary file, ids are those of
    its pieces of the texts as written, and there is no word list.
    """
    kept = [c for c in df.columns if keep_text or c not in (article, summary)]
    if subwords is not None:
        cut = F.col(article) if char_limit is None else T.truncate_chars(article, char_limit)
        ids = df.withColumns(
            {
                "input_raw": E.truncate_ids(encode_subwords(cut, subwords), article_tokens),
                "target_raw": E.truncate_ids(encode_subwords(summary, subwords), summary_tokens),
            }
        )
    else:
        ids = _word_ids(df, vocabulary, article, summary, article_tokens, summary_tokens, char_limit)
    return ids.select(
        *kept,
        E.pad_ids("input_raw", article_tokens).alias("input_ids"),
        E.attention_mask("input_raw", article_tokens).alias("attention_mask"),
        E.labels(E.pad_ids("target_raw", summary_tokens), mask=mask_labels).alias("labels"),
    )


def _word_ids(df, vocabulary, article, summary, article_tokens, summary_tokens, char_limit) -> DataFrame:
    return df.withColumns(
        {
            "input_tokens": E.truncate_ids(example_tokens(article, char_limit), article_tokens),
            "target_tokens": E.truncate_ids(example_tokens(summary), summary_tokens),
        }
    ).withColumns(
        {
            "input_raw": E.encode("input_tokens", vocabulary),
            "target_raw": E.encode("target_tokens", vocabulary),
        }
    )


def encode_joined(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, name: str = "ids") -> DataFrame:
    """Add token ids by a join with a vocabulary table (token, token_id) of any size.

    ``key`` is unique.  For word lists that are too large to send to every task; smaller ones need no shuffle with
    :func:`textfacts.functions.encoding.encode`.  A token of very many rows is split by the adaptive join.
    """
    placed = df.select(key, F.posexplode(tokens).alias("at", "token"))
    found = placed.join(vocabulary.select("token", "token_id"), "token", "left")
    one = F.struct("at", F.coalesce("token_id", F.lit(E.UNKNOWN_ID)).cast("int").alias("id"))
    lists = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["id"]).alias(name))
    empty = F.when(F.col(tokens).isNotNull(), F.array().cast("array<int>"))
    return df.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def with_input_lengths(df: DataFrame, tokens: str, model_id: str = "model_id") -> DataFrame:
    """Add ``input_length`` and ``padded_length`` for a row's token count and model.

    Inputs are cut to the model's context; only long-context models pad to
    whole attention windows.
    """
    long_context = T.is_long_context(model_id)
    limit = F.when(long_context, C.LONG_CONTEXT_TOKENS).otherwise(C.SHORT_CONTEXT_TOKENS)
    kept = F.when(F.col(tokens).isNotNull(), F.least(F.col(tokens), limit))
    return df.withColumn("input_length", kept).withColumn(
        "padded_length",
        F.when(long_context, E.padded_length("input_length")).otherwise(F.col("input_length")),
    )


def model_structs(models: Mapping[str, str] = C.MODELS) -> Column:
    """The model list as an array literal, to explode beside each row."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("model_name"), F.lit(model_id).alias("model_id"))
            for name, model_id in models.items()
        ]
    )


def per_model(df: DataFrame, models: Mapping[str, str] = C.MODELS) -> DataFrame:
    """Every row once per model; the fixed model list is a literal, not a join."""
    return df.select("*", F.inline(model_structs(models)))
