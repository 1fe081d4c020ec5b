"""Hashes as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol_hash(path: Column, body: Column) -> Column:
    """``sym:`` and 16 bytes in hex over a path and a definition, whatever its white space; each part ends with a zero byte."""
    plain = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.concat(F.lit("sym:"), F.substring(F.sha2(F.concat(path, F.lit("\0"), plain, F.lit("\0")), 256), 1, 32))


def cache_key(*parts: Column) -> Column:
    """The content-addressed key of a piece of work."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def log_name(session: Column) -> Column:
    return F.substring(F.sha2(session, 256), 1, 24)


FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DIMENSION = 1024


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the bytes of a text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, b: (F.lit(FNV_PRIME) * h.bitwiseXOR(F.conv(b, 16, 10).cast("long"))) % F.lit(1 << 32)
    return F.aggregate(pairs, F.lit(FNV_OFFSET).cast("long"), step)


def hash_embedding(tokens: Column, dim: int) -> Column:
    """Counts of tokens by hash modulo the dimension, of length one; the first unit vector for none."""
    slots = F.transform(tokens, lambda t: (fnv1a(t) % dim).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(length > 0, F.transform(counts, lambda x: x / length)).otherwise(unit)


@lru_cache(maxsize=1 << 16)
def _fnv1a(word: str) -> int:
    h = FNV_OFFSET
    for b in word.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


def embed(rows: DataFrame, dim: int = DIMENSION) -> DataFrame:
    """(id, at, x): what is not 0 of the vector of each text, as :func:`hash_embedding` of all its words. rows: (id, text).

    A row is embedded where it stands, with the hashes of words that the worker has seen.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, x = [], [], []
            for n, ws in enumerate(b.column(1).to_pylist()):
                counts: dict[int, int] = {}
                for w in ws:
                    k = _fnv1a(w) % dim
                    counts[k] = counts.get(k, 0) + 1
                counts = counts or {0: 1}
                length = math.sqrt(sum(c * c for c in counts.values()))
                row += [n] * len(counts)
                at += counts
                x += [c / length for c in counts.values()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(x, pa.float64())], ["id", "at", "x"])

    return rows.select("id", words.alias("words")).mapInArrow(run, "id string, at int, x double")
