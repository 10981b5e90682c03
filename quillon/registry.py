"""All queries of the general operators and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import flagship as _flagship

Query = Callable[[SparkSession, str], DataFrame]


def modules() -> list:
    from .plans import agents, concepts, conversations, files, joins, logs, matrices, metrics, packs, reports, rewards, rowfuncs, samples, shapes, sources, stats, streams, texts, values

    return [conversations, texts, samples, joins, stats, logs, rewards, metrics, matrices, packs, sources, files, rowfuncs, shapes, concepts, streams, agents, reports, values]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship.query(spark, sf_dir)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"flagship": flagship}
    for m in modules():
        for name, (f, _) in m.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = f
    return found


def oracle_sql() -> dict[str, str]:
    found = {"flagship": _flagship.SQL}
    for m in modules():
        found |= {name: sql for name, (_, sql) in m.QUERIES.items() if sql}
    return found
