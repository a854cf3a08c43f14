"""What a catalog offers; all but listing and loading is refused unless a provider has it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sql.text import NotSupported, SqlError


@dataclass
class TableInfo:
    """Enough to print a table's definition."""

    columns: list[tuple[str, str, bool]]
    partitions: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    using: str = ""
    location: str = ""
    options: dict[str, str] = field(default_factory=dict)


class Catalog:
    kind = "INTERNAL"

    def schemas(self) -> list[str]:
        raise NotImplementedError

    def tables(self, schema: str) -> list[str]:
        raise NotImplementedError

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        raise NotImplementedError

    def info(self, spark: SparkSession, schema: str, table: str) -> TableInfo:
        raise NotSupported(f"SHOW CREATE TABLE isn't supported for {self.kind}")

    def require(self, schema: str, table: str | None = None) -> None:
        if schema not in self.schemas():
            raise SqlError(f"schema {schema!r} doesn't exist")
        if table is not None and table.split("$")[0] not in self.tables(schema):
            raise SqlError(f"table {schema}.{table} doesn't exist")

    def _refuse(self, what: str):
        raise NotSupported(f"{self.kind} is read-only: {what} isn't supported")

    def create_schema(self, schema: str, if_not_exists: bool) -> None:
        self._refuse("CREATE SCHEMA")

    def drop_schema(self, schema: str, if_exists: bool, cascade: bool) -> None:
        self._refuse("DROP SCHEMA")

    def create_table(self, spark: SparkSession, schema: str, table: str, info: TableInfo, if_not_exists: bool) -> bool:
        self._refuse("CREATE TABLE")
        return False

    def drop_table(self, schema: str, table: str, if_exists: bool) -> None:
        self._refuse("DROP TABLE")

    def insert(self, spark: SparkSession, schema: str, table: str, rows: DataFrame, overwrite: bool) -> int:
        self._refuse("INSERT")
        return 0

    def call(self, spark: SparkSession, procedure: str, schema: str, table: str, args: dict[str, str]) -> None:
        self._refuse("CALL")


class FileCatalog(Catalog):
    """Folders of Parquet tables: schema name to folder; ``<table>.parquet`` files or folders are tables."""

    kind = "FILES"

    def __init__(self, folders: dict[str, str]) -> None:
        self.folders = folders

    def schemas(self) -> list[str]:
        return sorted(self.folders)

    def tables(self, schema: str) -> list[str]:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folders[schema])
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        self.require(schema, table)
        return spark.read.parquet(f"{self.folders[schema]}/{table}.parquet")


class InternalCatalog(Catalog):
    """Always there: information_schema.variables(name, value, description)."""

    def schemas(self) -> list[str]:
        return ["information_schema"]

    def tables(self, schema: str) -> list[str]:
        return ["variables"]

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        self.require(schema, table)
        return spark.sql("SET -v").selectExpr("key as name", "value", "meaning as description")
