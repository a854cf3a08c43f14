"""All registered queries of the engine with their DuckDB counterparts.

Most are one text for both: ``{table}`` is a DataFrame of the table on Spark and the view of that
name in DuckDB.  Those of keyed-table merging, sources and metadata are written with the engine's
own operators, with the SQL of what they must give beside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import own_queries
from .sql_texts import DUCK, SPARK

Query = Callable[[SparkSession, str], DataFrame]
TABLE = re.compile(r"\{(\w+)\}")


def _run(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(TABLE.findall(text)))}
        return spark.sql(text, **tables)

    return query


def queries() -> dict[str, Query]:
    return {name: _run(text) for name, text in SPARK.items()} | own_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: TABLE.sub(r"\1", DUCK.get(name, text)) for name, text in SPARK.items()} | own_queries.oracle_sql()
