"""JSON attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_map(attrs: Column) -> Column:
    """Attributes as text values: strings as they are, others as JSON; empty for none. Of a repeated key the last value counts."""
    m = F.coalesce(F.from_json(attrs, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keys = F.array_distinct(F.map_keys(m))
    once = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)["value"]))
    return F.when(F.size(keys) == F.size(F.map_keys(m)), m).otherwise(once)


def merge(left: Column, right: Column) -> Column:
    """Shallow merge of two maps, the right one wins."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def to_object(m: Column) -> Column:
    """A map as a JSON object with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def model_json(c: Column) -> Column:
    """The JSON object of a model's answer: no thinking, no code fence, nothing outside the outer braces."""
    plain = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))
