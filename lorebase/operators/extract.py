"""Checks of texts that a model wrote against the texts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import secrets
from lorebase.functions.text import collapse, word_tokens

LENGTHS, CONFIDENCE_LEAST, GROUNDED, A_SOURCE = (8, 400), 0.5, 0.7, 8
QUOTED_LEAST, QUOTES = 40, ('"([^"]*)"', "“([^”]*)”", "「([^」]*)」", "(?s)```(.*?)```")
DIGEST_LENGTHS = (40, 3000)
CODE_TOKEN = r"(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]+|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b|\b\d+\.\d+\.\d+\b"


def share_of_tokens(text: Column, source: Column) -> Column:
    """Share of the text's tokens that the source has."""
    t = word_tokens(text)
    have = F.array_distinct(word_tokens(source))
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.array_contains(have, x))) / F.size(t)).otherwise(0.0)


def grounded(text: Column, source: Column) -> Column:
    """Whether a text stands in its source, as it is or with most of its tokens."""
    inside = F.contains(F.lower(collapse(source)), F.lower(collapse(text)))
    return F.coalesce(inside | (share_of_tokens(text, source) >= GROUNDED), F.lit(False))


def quoted_spans(text: Column) -> Column:
    """Long quoted spans of a text. Each kind of quotes is paired by itself, short ones too: what stands between two quotes is no span."""
    spans = F.concat(*(F.regexp_extract_all(text, F.lit(q), F.lit(1)) for q in QUOTES))
    return F.filter(spans, lambda x: F.length(x) >= QUOTED_LEAST)


def inside_quoted(text: Column, source: Column) -> Column:
    """Whether a text only repeats what its source quotes, as it is or with most of its tokens in one quote."""
    return F.coalesce((F.size(word_tokens(text)) > 0) & F.exists(quoted_spans(source), lambda q: grounded(text, q)), F.lit(False))


def validate(candidates: DataFrame) -> DataFrame:
    """(cand_id, source_id, reject_reason): null reason for what is kept, else the first that holds. candidates: cand_id, source_id, text, source,
    confidence. Of equal texts of one source the first is kept, and A_SOURCE of each source by confidence."""
    c = candidates.withColumn("plain", collapse(F.coalesce("text", F.lit(""))))
    n = F.length("plain")
    first = (
        F.when(n < LENGTHS[0], "short")
        .when(n > LENGTHS[1], "long")
        .when(F.size(secrets.findings(F.col("plain"))) > 0, "secret")
        .when(F.coalesce("confidence", F.lit(0.0)) < CONFIDENCE_LEAST, "unsure")
        .when(~grounded(F.col("plain"), F.coalesce("source", F.lit(""))), "not_grounded")
        .when(inside_quoted(F.col("plain"), F.coalesce("source", F.lit(""))), "quoted")
    )
    c = c.withColumn("r", first)
    # one source's candidates are few (a model writes them), but copies of one source may be many: both windows keep to (source, ...)
    again = F.row_number().over(Window.partitionBy("source_id", "r", F.lower("plain")).orderBy("cand_id"))
    c = c.withColumn("r", F.coalesce("r", F.when(again > 1, "repeated")))
    place = F.row_number().over(Window.partitionBy("source_id", "r").orderBy(F.desc("confidence"), "cand_id"))
    return c.select("cand_id", "source_id", F.coalesce("r", F.when(place > A_SOURCE, "too_many")).alias("reject_reason"))


def digest_check(rows: DataFrame) -> DataFrame:
    """(digest_id, reject_reason): length, secrets, and code-like tokens that no source has. rows: digest_id, text, source, one row per source.

    The tokens a source lacks are what its row carries; a token is unknown where as many rows lack it as the digest has.
    """
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(CODE_TOKEN), F.lit(0)))
    each = rows.select("digest_id", "text", F.filter(codes, lambda t: ~F.contains(F.coalesce("source", F.lit("")), t)).alias("lacks"))
    n_sources = each.groupBy("digest_id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    lacking = each.select("digest_id", F.explode("lacks").alias("t")).groupBy("digest_id", "t").agg(F.count("*").alias("k"))
    unknown = lacking.join(n_sources.select("digest_id", "n"), "digest_id").filter("k = n").select("digest_id").distinct().withColumn("unknown", F.lit(True))
    n = F.length(F.coalesce("text", F.lit("")))
    reason = (
        F.when(n < DIGEST_LENGTHS[0], "short")
        .when(n > DIGEST_LENGTHS[1], "long")
        .when(F.size(secrets.findings(F.col("text"))) > 0, "secret")
        .when(F.coalesce("unknown", F.lit(False)), "unknown_code")
    )
    return n_sources.join(unknown, "digest_id", "left").select("digest_id", reason.alias("reject_reason"))
