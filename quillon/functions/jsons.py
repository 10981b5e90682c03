"""JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import literal_json


def lenient(x: Column) -> Column:
    """VARIANT of JSON, or of a Python literal; null if neither (J1). Only texts that are no JSON reach the literal reader."""
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(literal_json(F.when(F.try_parse_json(x).isNull(), x))))


def concept_error(raw: Column) -> Column:
    """Why a concept answer is refused, null if it isn't: it must be an object whose only key is `concepts`, 1 to 8 non-blank strings."""
    keys = F.json_object_keys(raw)
    items = F.from_json(F.get_json_object(raw, "$.concepts"), "array<string>")
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty")
        .when(F.try_parse_json(raw).isNull(), "invalid_json")
        .when(keys.isNull(), "not_object")
        .when(~F.array_contains(keys, "concepts"), "missing_key")
        .when(F.size(keys) != 1, "extra_keys")
        .when(items.isNull(), "not_array")
        .when((F.size(items) < 1) | (F.size(items) > 8), "bad_count")
        .when(F.exists(items, lambda c: c.isNull() | (F.trim(c) == "")), "blank_concept")
    )


def argument_f1(mine: Column, gold: Column) -> Column:
    """Agreement of two JSON argument maps: equal values count 1, equal keys 1/2, over both sizes."""
    a, b = F.from_json(mine, "map<string,string>"), F.from_json(gold, "map<string,string>")
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    hits = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.when(a[k].eqNullSafe(b[k]), 1.0).otherwise(0.5))
    n = F.size(F.map_keys(a)) + F.size(F.map_keys(b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(n == 0, 1.0).otherwise(2 * hits / n)
