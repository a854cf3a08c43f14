"""Merge rules of keyed tables: one row for each primary key, as grouped aggregates.

All are partial aggregates before one shuffle on the key; no window sort is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = ("sum", "product", "min", "max", "last_value", "first_value", "last_non_null_value", "first_non_null_value", "bool_and", "bool_or", "listagg")


def _order(sequence: Sequence[str]) -> Column:
    """Later wins: by the sequence columns in turn; null sorts before all."""
    return F.struct(*[F.col(c) for c in sequence])


def _pick(df: DataFrame, keys: Sequence[str], sequence: Sequence[str], best) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(best(whole, _order(sequence)).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in df.columns])


def deduplicate(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, sequence, F.max_by)


def first_row(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _pick(df, keys, sequence, F.min_by)


def partial_update(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last value that isn't null, of each field by itself."""
    order = _order(sequence)
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]).select(*df.columns)


def _aggregate(name: str, c: str, order: Column) -> Column:
    col, given = F.col(c), F.when(F.col(c).isNotNull(), order)
    rules = {
        "sum": lambda: F.sum(col),
        "product": lambda: F.product(col),
        "min": lambda: F.min(col),
        "max": lambda: F.max(col),
        "last_value": lambda: F.max_by(col, order),
        "first_value": lambda: F.min_by(col, order),
        "last_non_null_value": lambda: F.max_by(col, given),
        "first_non_null_value": lambda: F.min_by(col, given),
        "bool_and": lambda: F.bool_and(col),
        "bool_or": lambda: F.bool_or(col),
        # in order of the sequence; the list of a key is as long as the key has rows
        "listagg": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(col.isNotNull(), F.struct(order.alias("o"), col.cast("string").alias("v"))))), lambda x: x["v"]), ","),
    }
    if name not in rules:
        raise ValueError(f"unknown aggregate function {name!r}; there are {', '.join(AGGREGATES)}")
    return rules[name]()


def aggregation(df: DataFrame, keys: Sequence[str], sequence: Sequence[str], functions: dict[str, str]) -> DataFrame:
    """Each field by its own function; one without takes its last value that isn't null, a sequence field its last value."""
    order = _order(sequence)
    out = []
    for c in df.columns:
        if c not in keys:
            name = "last_value" if c in sequence else functions.get(c, "last_non_null_value")
            out.append(_aggregate(name, c, order).cast(df.schema[c].dataType).alias(c))
    return df.groupBy(*keys).agg(*out).select(*df.columns)


def merge(df: DataFrame, engine: str, keys: Sequence[str], sequence: Sequence[str], functions: dict[str, str] | None = None) -> DataFrame:
    """By the name of the merge engine."""
    if engine == "aggregation":
        return aggregation(df, keys, sequence, functions or {})
    rules = {"deduplicate": deduplicate, "first-row": first_row, "partial-update": partial_update}
    if engine not in rules:
        raise ValueError(f"unknown merge engine {engine!r}")
    return rules[engine](df, keys, sequence)
