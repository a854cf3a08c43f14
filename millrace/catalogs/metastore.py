"""A catalog over a metastore: it tells a table's format from its properties and reads it by that format.

The metastore is any object with ``databases()``, ``tables(database)`` and ``table(database, name)``, and with
``column_statistics(database, name, columns)`` if it keeps some;
:class:`DictMetastore` keeps its entries in memory, as a file or a test gives them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..sources import delta, hive
from ..sources.iceberg import IcebergTable
from ..sql.text import NotSupported, SqlError
from . import statistics
from .base import Catalog, TableInfo
from .keyed import KeyedCatalog


@dataclass
class Entry:
    """What a metastore knows of a table; columns are (name, type string), partitions (location, raw values)."""

    location: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    partition_columns: list[tuple[str, str]] = field(default_factory=list)
    input_format: str = ""
    serde: str = ""
    serde_parameters: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, str] = field(default_factory=dict)
    table_type: str = "EXTERNAL_TABLE"
    partitions: list[tuple[str, list[str]]] | None = None
    column_statistics: dict[str, dict] = field(default_factory=dict)


class Metastore(Protocol):
    def databases(self) -> list[str]: ...

    def tables(self, database: str) -> list[str]: ...

    def table(self, database: str, name: str) -> Entry: ...


class DictMetastore:
    """Entries by database and table."""

    def __init__(self, entries: dict[str, dict[str, Entry]]) -> None:
        self.entries = entries

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> DictMetastore:
        """From a JSON file, database to table to the fields of :class:`Entry`, in any store that Spark reads."""
        text = spark.read.option("wholetext", True).text(path).first()[0]
        pairs = ("columns", "partition_columns", "partitions")
        made = {d: {t: Entry(**{k: [tuple(x) for x in v] if k in pairs and v is not None else v for k, v in e.items()}) for t, e in own.items()} for d, own in json.loads(text).items()}
        return cls(made)

    def databases(self) -> list[str]:
        return sorted(self.entries)

    def tables(self, database: str) -> list[str]:
        return sorted(self.entries[database])

    def table(self, database: str, name: str) -> Entry:
        return self.entries[database][name]

    def column_statistics(self, database: str, name: str, columns: list[str]) -> dict[str, dict]:
        told = self.table(database, name).column_statistics
        return {c: told[c] for c in columns if c in told}


class MetastoreCatalog(Catalog):
    """Read-only; ``t$suffix`` names a metadata table where the format has it."""

    kind = "HMS"

    def __init__(self, metastore: Metastore) -> None:
        self.metastore = metastore
        self.cache = statistics.Cache()

    def schemas(self) -> list[str]:
        return self.metastore.databases()

    def tables(self, schema: str) -> list[str]:
        return self.metastore.tables(schema)

    def _entry(self, schema: str, table: str) -> tuple[str, Entry]:
        self.require(schema, table)
        e = self.metastore.table(schema, table)
        return hive.table_format(e.parameters, e.table_type, input_format=e.input_format), e

    @staticmethod
    def _hive(e: Entry) -> hive.Table:
        return hive.Table(e.location, e.columns, hive.storage_format(e.input_format, e.serde), e.partition_columns, e.parameters | e.serde_parameters, e.partitions)

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        base, _, meta = table.partition("$")
        kind, e = self._entry(schema, base)
        if kind == "iceberg":
            if "metadata_location" not in e.parameters:
                raise SqlError(f"table {schema}.{base} has no metadata_location")
            own = IcebergTable(spark, e.parameters["metadata_location"])
            return own.metadata(meta) if meta else own.scan()
        if kind == "paimon":
            root, db, name = e.location.rstrip("/").rsplit("/", 2)
            return KeyedCatalog(root).load(spark, db.removesuffix(".db"), f"{name}${meta}" if meta else name)
        if kind == "delta":
            if meta:
                raise NotSupported(f"metadata table {meta} of a Delta table")
            return delta.read(spark, e.location)
        if not meta:
            return hive.scan(spark, self._hive(e))
        if meta not in ("data_files", "partitions"):
            raise NotSupported(f"metadata table {meta} of a Hive table")
        return getattr(hive, meta)(spark, self._hive(e))

    def info(self, spark: SparkSession, schema: str, table: str) -> TableInfo:
        if "$" in table:
            raise NotSupported("a metadata table has no definition")
        kind, e = self._entry(schema, table)
        columns = [(f.name, f.dataType.simpleString(), True) for f in self.load(spark, schema, table).schema]
        return TableInfo(columns, [n for n, _ in e.partition_columns], [], "" if kind == "hive" else kind, e.location, dict(e.parameters))

    def statistics(self, spark: SparkSession, schema: str, table: str, keep: str | None = None) -> statistics.Statistics:
        """Of a Hive table, or of the partitions that ``keep`` leaves; columns only of tables without partitions."""
        kind, e = self._entry(schema, table)
        if kind != "hive":
            raise NotSupported(f"statistics of {kind} tables")
        own = self._hive(e)
        want = hive.table_schema(own.columns, own.partition_columns)

        def load() -> tuple[statistics.Statistics, bool]:
            told, complete = {}, True
            if not own.partition_columns and hasattr(self.metastore, "column_statistics"):
                told, complete = statistics.columns(lambda names: self.metastore.column_statistics(schema, table, names), want)
            known = statistics.from_properties(e.parameters)
            return statistics.Statistics(known.rows, known.size, told), complete

        known = self.cache.get((schema, table), want, load)
        if keep is None and None not in (known.rows, known.size):
            return known
        chosen = hive.kept_partitions(spark, own, keep) if own.partition_columns else [(own.location, [])]
        files = hive.data_files(spark, hive.Table(own.location, own.columns, own.format, own.partition_columns, own.options, chosen))
        return statistics.from_files(known, want, [f["file_size"] for f in files.collect()], keep is not None and bool(own.partition_columns))
