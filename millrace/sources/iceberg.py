"""Iceberg tables from their metadata file: snapshot, manifests, data files and position deletes; metadata tables.

The manifest list is read by the driver (a row for each manifest); manifests are decoded by the
executors.  Columns are found by field id, so renamed, moved and added ones read right.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql.text import NotSupported, SqlError
from .avro import records

#: Fixed names of primitive types.
TYPES = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "binary", "binary": "binary"}
#: Fixed: the counters of a manifest, for data and for deletes.
COUNTS = ("added", "existing", "deleted")
BROADCAST_DELETES = 1_000_000  # deleted positions; beyond it the join shuffles


def _type(kind: Any) -> T.DataType:
    if isinstance(kind, str):
        if kind.startswith("fixed["):
            return T.BinaryType()
        name = kind.replace(" ", "") if kind.startswith("decimal") else TYPES.get(kind)
        if name is None:
            raise NotSupported(f"Iceberg type {kind}")
        return T.DataType.fromDDL(name)
    if kind["type"] == "struct":
        return _struct(kind)
    if kind["type"] == "list":
        return T.ArrayType(_type(kind["element"]), not kind["element-required"])
    return T.MapType(_type(kind["key"]), _type(kind["value"]), not kind["value-required"])


def _struct(kind: dict) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _type(f["type"]), True, {"parquet.field.id": f["id"]}) for f in kind["fields"]])


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _plain(path: Column) -> Column:
    """A local path without its scheme, in whichever way that is written."""
    return F.regexp_replace(path, "^file:/+", "/")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content) of manifests to a row for each live entry."""
    for batch in batches:
        for content in batch.column(0):
            rows = [e["data_file"] for e in records(content.as_py()) if e["status"] < 2]
            columns = [pa.array([r.get("content") or 0 for r in rows], pa.int32()), pa.array([r["file_path"] for r in rows], pa.string()), pa.array([r["file_format"].upper() for r in rows], pa.string()), pa.array([r["record_count"] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "file_path", "file_format", "record_count"])


class IcebergTable:
    """A table as one metadata file states it; it never changes."""

    def __init__(self, spark: SparkSession, metadata_location: str) -> None:
        self.spark, self.meta = spark, json.loads(_content(spark, metadata_location))
        if self.meta["format-version"] not in (1, 2):
            raise NotSupported(f"Iceberg format version {self.meta['format-version']}")

    def schema(self, schema_id: int | None = None) -> T.StructType:
        wanted = self.meta.get("current-schema-id") if schema_id is None else schema_id
        own = next((s for s in self.meta.get("schemas", []) if s["schema-id"] == wanted), None) or self.meta["schema"]
        return _struct(own)

    def _snapshot(self, snapshot_id: int | None) -> dict | None:
        wanted = self.meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
        if wanted in (None, -1):
            return None
        for s in self.meta.get("snapshots", []):
            if s["snapshot-id"] == wanted:
                return s
        raise SqlError(f"snapshot {wanted} doesn't exist")

    def _manifests(self, snapshot: dict | None) -> list[dict]:
        if snapshot is None:
            return []
        if "manifest-list" not in snapshot:
            return [{"manifest_path": p} for p in snapshot["manifests"]]
        return list(records(_content(self.spark, snapshot["manifest-list"])))

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        """(content, file_path, file_format, record_count) of the live files; content 0 data, 1 position and 2 equality deletes."""
        paths = [m["manifest_path"] for m in self._manifests(self._snapshot(snapshot_id))]
        ddl = "content int, file_path string, file_format string, record_count long"
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.format("binaryFile").load(paths).select("content").mapInArrow(_entries, ddl)

    def scan(self, snapshot_id: int | None = None) -> DataFrame:
        """The rows of a snapshot, by the current schema, or by the snapshot's own if one is named."""
        snapshot = self._snapshot(snapshot_id)
        schema = self.schema(snapshot.get("schema-id") if snapshot and snapshot_id is not None else None)
        files = self.files(snapshot_id).collect()  # as many rows as the file index of any scan holds
        if any(f["file_format"] != "PARQUET" for f in files):
            raise NotSupported("Iceberg data other than Parquet")
        if any(f["content"] == 2 for f in files):
            raise NotSupported("Iceberg equality deletes")
        data, deletes = [f["file_path"] for f in files if f["content"] == 0], [f for f in files if f["content"] == 1]
        if not data:
            return self.spark.createDataFrame([], schema)
        if "schema.name-mapping.default" in self.meta.get("properties", {}):
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # files without ids go by name
        else:
            self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        rows = self.spark.read.schema(schema).parquet(*data)
        if not deletes:
            return rows
        gone = self.spark.read.schema("file_path string, pos long").parquet(*[f["file_path"] for f in deletes])
        gone = gone.select(_plain(F.col("file_path")).alias("__path"), F.col("pos").alias("__pos"))
        if sum(f["record_count"] for f in deletes) <= BROADCAST_DELETES:
            gone = F.broadcast(gone)
        placed = rows.select("*", _plain(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.row_index").alias("__pos"))
        return placed.join(gone, ["__path", "__pos"], "left_anti").select(*[F.col(f"`{n}`") for n in schema.names])

    # -------------------------------------------------- metadata tables
    def snapshots(self) -> DataFrame:
        rows = [(s["timestamp-ms"], s["snapshot-id"], s.get("parent-snapshot-id"), s.get("summary", {}).get("operation"), s.get("manifest-list"), {k: v for k, v in s.get("summary", {}).items() if k != "operation"}) for s in self.meta.get("snapshots", [])]
        df = self.spark.createDataFrame(rows, "committed_at long, snapshot_id long, parent_id long, operation string, manifest_list string, summary map<string,string>")
        return df.withColumn("committed_at", F.timestamp_millis("committed_at"))

    def history(self) -> DataFrame:
        parents = {s["snapshot-id"]: s.get("parent-snapshot-id") for s in self.meta.get("snapshots", [])}
        line, at = set(), self.meta.get("current-snapshot-id")
        while at in parents and at not in line:
            line.add(at)
            at = parents[at]
        rows = [(e["timestamp-ms"], e["snapshot-id"], parents.get(e["snapshot-id"]), e["snapshot-id"] in line) for e in self.meta.get("snapshot-log", [])]
        df = self.spark.createDataFrame(rows, "made_current_at long, snapshot_id long, parent_id long, is_current_ancestor boolean")
        return df.withColumn("made_current_at", F.timestamp_millis("made_current_at"))

    def manifests(self) -> DataFrame:
        rows = []
        for m in self._manifests(self._snapshot(None)):
            content = m.get("content") or 0
            n = [m.get(f"{c}_data_files_count", m.get(f"{c}_files_count")) for c in COUNTS]
            parts = [(p["contains_null"], p.get("contains_nan"), None if p.get("lower_bound") is None else p["lower_bound"].hex(), None if p.get("upper_bound") is None else p["upper_bound"].hex()) for p in m.get("partitions") or []]
            zero = [0, 0, 0]
            rows.append((content, m["manifest_path"], m.get("manifest_length"), m.get("partition_spec_id"), m.get("added_snapshot_id"), *(zero if content else n), *(n if content else zero), parts))
        counts = ", ".join(f"{c}_{kind}_files_count int" for kind in ("data", "delete") for c in COUNTS)
        return self.spark.createDataFrame(rows, f"content int, path string, length long, partition_spec_id int, added_snapshot_id long, {counts}, partition_summaries array<struct<contains_null:boolean,contains_nan:boolean,lower_bound:string,upper_bound:string>>")

    def metadata(self, suffix: str) -> DataFrame:
        if suffix not in ("snapshots", "manifests", "history"):
            raise NotSupported(f"Iceberg metadata table {suffix}")
        return getattr(self, suffix)()
