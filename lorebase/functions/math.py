"""Scores and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is set aside at least for a call.
RESERVE_LEAST = 0.05


def scaled(rows: DataFrame, keys: list[str], raw: str, out: str) -> DataFrame:
    """rows with out: scores as they are where all of a run (keys) lie in 0..1, else through the logistic function. Null keys are a run."""
    whole = rows.groupBy(*keys).agg(F.bool_and(F.col(raw).between(0, 1)).alias("_fine"))
    whole = whole.select(*(F.col(k).alias(f"_{k}") for k in keys), "_fine")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = rows.join(whole, same)
    return j.withColumn(out, F.when(F.col("_fine"), F.col(raw)).otherwise(1 / (1 + F.exp(-F.col(raw))))).drop("_fine", *(f"_{k}" for k in keys))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are per million tokens."""
    return tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6


def reserve(c: Column, least: float = RESERVE_LEAST) -> Column:
    return F.greatest(c, F.lit(least))
