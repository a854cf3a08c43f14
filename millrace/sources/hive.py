"""Metastore-style tables in text, Parquet, ORC and Avro: options, partitions and pruning."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql.text import NotSupported, SqlError
from . import avro
from .hive_types import parse_type, table_schema

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed name of the null partition
NULL_TEXT = "\\N"
#: Fixed class names of storage formats.
FORMATS = {
    ("org.apache.hadoop.mapred.TextInputFormat", "org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe"): "textfile",
    ("org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat", "org.apache.hadoop.hive.ql.io.parquet.serde.ParquetHiveSerDe"): "parquet",
    ("org.apache.hadoop.hive.ql.io.orc.OrcInputFormat", "org.apache.hadoop.hive.ql.io.orc.OrcSerde"): "orc",
    ("org.apache.hadoop.hive.ql.io.avro.AvroContainerInputFormat", "org.apache.hadoop.hive.serde2.avro.AvroSerDe"): "avro",
}


def storage_format(input_format: str, serde: str) -> str:
    if (input_format, serde) not in FORMATS:
        raise NotSupported(f"storage format {input_format} with {serde}")
    return FORMATS[input_format, serde]


#: Fixed: the packages whose input formats are Hudi's, and kinds of views.
HUDI = ("org.apache.hudi.", "com.uber.hoodie.")
VIEWS = ("VIRTUAL_VIEW", "MATERIALIZED_VIEW")


def table_format(properties: dict[str, str], table_type: str = "EXTERNAL_TABLE", provider: str = "", input_format: str = "") -> str:
    """iceberg, paimon, delta or hive; other kinds of tables are refused."""
    p = {k.lower(): v.lower() for k, v in properties.items()}
    if p.get("table_type") == "iceberg":
        return "iceberg"
    if p.get("table_type") == "paimon" or "paimon" in p.get("storage_handler", ""):
        return "paimon"
    if p.get("spark.sql.sources.provider", provider).lower() == "delta" or p.get("table_type") == "delta":
        return "delta"
    if p.get("spark.sql.sources.provider") == "hudi" or "hudi" in p.get("storage_handler", "") or input_format.startswith(HUDI):
        raise NotSupported("Hudi tables")
    if table_type.upper() in VIEWS:
        raise NotSupported("views")
    if p.get("transactional") == "true":
        raise NotSupported("transactional tables")
    return "hive"


@dataclass
class Table:
    """location, columns and partition columns (name, type string), format, SerDe options, registered partitions."""

    location: str
    columns: list[tuple[str, str]]
    format: str = "parquet"
    partition_columns: list[tuple[str, str]] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    partitions: list[tuple[str, list[str]]] | None = None  # (location, raw values); None: found below the location


#: Fixed: property keys of the field delimiter, the first that is set counts, and names of escaped bytes.
FIELD_KEYS = ("field.delim", "serialization.format", "serdeConstants.FIELD_DELIM", "columns.delimited.by")
ESCAPED = {"\\t": "\t", "\\n": "\n", "\\r": "\r"}
#: Fixed: endings of compressed text that isn't read.
REFUSED_CODECS = (".snappy", ".deflate", ".lzo", ".lzo_deflate", ".lz4", ".xz")


def delimiter(raw: str) -> str:
    """A delimiter's character: a decimal byte (negative ones count from 256), an escape, or the first character."""
    if raw in ESCAPED:
        return ESCAPED[raw]
    for pattern, base in ((r"(-?\d{1,3})", 10), (r"\\u([0-9A-Fa-f]+)", 16), (r"\\([0-7]+)", 8), (r"0x([0-9A-Fa-f]+)", 16)):
        if (m := re.fullmatch(pattern, raw)) and -128 <= int(m[1], base) < (128 if base == 10 else 256):
            return chr(int(m[1], base) % 256)
    return raw[0]


def text_options(options: dict[str, str]) -> tuple[str, str, int]:
    """(delimiter, null text, header lines); what can't be honoured is refused."""
    if delimiter(options.get("line.delim") or "\n") != "\n":
        raise NotSupported("a line delimiter other than newline")
    if options.get("escape.delim") or options.get("escapeChar"):
        raise NotSupported("escape characters")
    count = options.get("skip.header.line.count", "0").strip()
    if not count.isdigit():
        raise SqlError(f"skip.header.line.count is no number: {count!r}")
    if int(count) > 1:
        raise NotSupported("more than one header line")
    field_key = next((k for k in FIELD_KEYS if k in options), None)
    return delimiter(options[field_key]) if field_key and options[field_key] else "\x01", options.get("serialization.null.format", NULL_TEXT), int(count)


def _text(spark: SparkSession, paths: list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """All fields as text, then the null text to null, then typed; a bad value is null."""
    sep, null, header = text_options(options)
    names = {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))).distinct().collect()}
    if bad := sorted(names & set(REFUSED_CODECS)):
        raise NotSupported(f"text compressed as {', '.join(bad)}")
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = spark.read.schema(raw).option("sep", sep).option("quote", "").option("header", bool(header)).option("enforceSchema", True).option("recursiveFileLookup", True).option("nullValue", null).option("mode", "PERMISSIVE").csv(paths)
    out = []
    for f in schema:
        c = F.when(F.col(f.name) != null, F.col(f.name))
        if isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.NullType)):
            c = F.lit(None).cast(f.dataType)
        elif not isinstance(f.dataType, T.StringType):
            c = F.trim(c).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def _files(spark: SparkSession, table: Table, paths: list[str], schema: T.StructType) -> DataFrame:
    if table.format == "textfile":
        return _text(spark, paths, schema, table.options)
    if table.format in ("parquet", "orc"):
        return spark.read.schema(schema).option("recursiveFileLookup", True).format(table.format).load(paths)
    if table.format == "avro":
        return avro.scan(spark, paths, schema)
    raise NotSupported(f"files of {table.format}")


def partition_value(raw: str, kind: T.DataType) -> Column:
    """A partition's value; '' and the default partition are null, text that doesn't fit is an error."""
    if raw in ("", DEFAULT_PARTITION):
        return F.lit(None).cast(kind)
    return F.lit(raw).cast(kind)


def found_partitions(spark: SparkSession, table: Table) -> list[tuple[str, list[str]]]:
    """Folders ``k=v/k=v`` below the location."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    level = [(table.location, [])]
    for name, _ in table.partition_columns:
        below = []
        for path, values in level:
            p = jvm.org.apache.hadoop.fs.Path(path)
            for f in p.getFileSystem(conf).listStatus(p):
                own = f.getPath().getName()
                if f.isDirectory() and own.lower().startswith(f"{name.lower()}="):
                    below.append((f.getPath().toString(), [*values, unquote(own.split("=", 1)[1])]))
        level = below
    return sorted(level)


def kept_partitions(spark: SparkSession, table: Table, keep: str | None = None) -> list[tuple[str, list[str]]]:
    """(location, raw values) of the partitions that a predicate on partition columns leaves."""
    keys = T.StructType([T.StructField(n, parse_type(t)) for n, t in table.partition_columns])
    parts = table.partitions if table.partitions is not None else found_partitions(spark, table)
    if keep is None or not parts:
        return parts
    # unreadable values are null for pruning, and a null predicate drops the partition
    listed = spark.createDataFrame([(k, *[None if v in ("", DEFAULT_PARTITION) else v for v in values]) for k, (_, values) in enumerate(parts)], T.StructType([T.StructField("__k", T.IntegerType()), *[T.StructField(f.name, T.StringType()) for f in keys]]))
    typed = listed.select("__k", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in keys])
    return [parts[r["__k"]] for r in typed.where(keep).orderBy("__k").collect()]


def scan(spark: SparkSession, table: Table, keep: str | None = None) -> DataFrame:
    """The table's rows; ``keep`` is a predicate on partition columns that decides which partitions are read."""
    own = T.StructType([T.StructField(n, parse_type(t)) for n, t in table.columns])
    if not table.partition_columns:
        return _files(spark, table, [table.location], own)
    keys = T.StructType([T.StructField(n, parse_type(t)) for n, t in table.partition_columns])
    if table.partitions is None and table.format in ("parquet", "orc"):
        # one scan, whose partitions Spark lists and prunes; it leaves '' and the default partition null
        names = {n.lower() for n in keys.names}
        rows = spark.read.schema(T.StructType([*[f for f in own if f.name.lower() not in names], *keys])).format(table.format).load(table.location)
        return rows.where(keep) if keep is not None else rows
    out = None
    for location, values in kept_partitions(spark, table, keep):
        if len(values) != len(keys):
            raise SqlError(f"partition {location} has {len(values)} values, {len(keys)} are wanted")
        df = _files(spark, table, [location], own).select("*", *[partition_value(v, f.dataType).alias(f.name) for v, f in zip(values, keys, strict=True)])
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], table_schema(table.columns, table.partition_columns))


def data_files(spark: SparkSession, table: Table) -> DataFrame:
    """(file_path, file_size): not empty, no part of the path below the table hidden."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []

    def walk(path) -> None:
        for f in path.getFileSystem(conf).listStatus(path):
            if f.getPath().getName()[0] in "_.":
                continue
            if f.isDirectory():
                walk(f.getPath())
            elif f.getLen():
                rows.append((f.getPath().toString(), f.getLen()))

    for location in [p for p, _ in table.partitions] if table.partitions is not None else [table.location]:
        walk(jvm.org.apache.hadoop.fs.Path(location))
    return spark.createDataFrame(sorted(rows), "file_path string, file_size long")


def partitions(spark: SparkSession, table: Table) -> DataFrame:
    """(partition, data_file_count, total_data_file_size); a registered partition without files counts 0."""
    rows = []
    if table.partition_columns:
        for location, values in table.partitions if table.partitions is not None else found_partitions(spark, table):
            files = data_files(spark, Table(location, table.columns)).collect()
            rows.append(("/".join(f"{n}={v}" for (n, _), v in zip(table.partition_columns, values, strict=True)), len(files), sum(f["file_size"] for f in files)))
    return spark.createDataFrame(rows, "partition string, data_file_count long, total_data_file_size long")
