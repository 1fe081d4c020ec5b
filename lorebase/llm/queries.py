"""Registered queries over training-data operators, and the SQL they are compared with."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import components, formatting, mixing, pii, residue, survivors, tokens
from lorebase.llm.oracle import ORACLE  # noqa: F401
from lorebase.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.copies(spark, table(spark, folder, "memories"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.collapsed(spark, table(spark, folder, "memories"))


def _p3(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "proposals"), table(spark, folder, "memories")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.providers(*_p3(spark, folder)).select("proposal_id", "field_name", "member_id")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(*_p3(spark, folder))


def p3_fronts(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.front_sizes(*_p3(spark, folder))


def _p4(spark: SparkSession, folder: str) -> DataFrame:
    return pii.texts(table(spark, folder, "memories"), table(spark, folder, "sessions"))


def _secret(spark: SparkSession) -> str:
    """The secret of the session; without one a secret of this run alone, so that nobody can undo what it keyed."""
    return spark.conf.get("spark.lorebase.pii.secret", None) or secrets.token_hex(32)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.linked(_p4(spark, folder), _secret(spark)).drop("pseudonym")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_p4(spark, folder), _secret(spark))


def _p5(spark: SparkSession, folder: str) -> DataFrame:
    return components.groups(spark, table(spark, folder, "match_pairs"), table(spark, folder, "proposals"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder).filter("group_id <> mem_id")


def p5_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder).groupBy("group_id").agg(F.count("*").alias("n_members"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(_documents(spark, folder))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_with_spans(_documents(spark, folder))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode(tokens.encode(_documents(spark, folder)))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(_documents(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(spark, _documents(spark, folder), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(spark, _documents(spark, folder), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found(_documents(spark, folder))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    return residue.kept(_documents(spark, folder)).select("doc_id", "source", "lang", "text")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return residue.report(_documents(spark, folder))


_ALL = (
    p2_found, p2_records, p3_found, p3_survivors, p3_fronts, p4_found, p4_redacted, p5_found, p5_sizes, p7_ids, p7_spans, p7_decoded, p7_round_trip,
    p8_mix, p8_shares, p9_found, p9_kept, p9_report,
)
QUERIES = {f.__name__: f for f in _ALL}
