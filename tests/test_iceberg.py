"""Iceberg tables written by hand: field ids, position deletes, snapshots and metadata tables."""

import json
import os
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.sources.avro import records
from millrace.sources.iceberg import IcebergTable


def number(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def encode(v, schema):
    if isinstance(schema, list):
        k = 0 if v is None else 1
        return number(k) + encode(v, schema[k])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return b"".join(encode(v.get(f["name"]), f["type"]) for f in schema["fields"])
    if kind == "null":
        return b""
    if kind == "string":
        return number(len(v.encode())) + v.encode()
    if kind == "array":
        return (number(len(v)) + b"".join(encode(x, schema["items"]) for x in v) if v else b"") + number(0)
    return number(v)


def container(path, schema, rows, codec="deflate"):
    def text(b):
        return number(len(b)) + b

    block = b"".join(encode(r, schema) for r in rows)
    if codec == "deflate":
        block = zlib.compress(block)[2:-4]
    head = number(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(codec.encode()) + number(0)
    path.write_bytes(b"Obj\x01" + head + b"s" * 16 + number(len(rows)) + text(block) + b"s" * 16)


def record(name, **fields):
    return {"type": "record", "name": name, "fields": [{"name": k, "type": t} for k, t in fields.items()]}


FILE = record("file", content="int", file_path="string", file_format="string", record_count="long")
ENTRY = record("entry", status="int", data_file=FILE)
LIST = record("list", manifest_path="string", manifest_length="long", partition_spec_id="int", content="int", added_snapshot_id=["null", "long"], added_data_files_count="int", existing_data_files_count="int", deleted_data_files_count="int", partitions=["null", {"type": "array", "items": record("p", contains_null="boolean")}])


@pytest.fixture
def location(tmp_path):
    def data(file, ids, **columns):
        fields = [pa.field(n, pa.array(v).type, metadata={"PARQUET:field_id": str(ids[n])}) for n, v in columns.items()]
        pq.write_table(pa.table([pa.array(v) for v in columns.values()], pa.schema(fields)), tmp_path / file)
        return f"file:{tmp_path}/{file}"

    a = data("a.parquet", {"id": 1, "old": 2}, id=[1, 2, 3], old=["x", "y", "z"])
    b = data("b.parquet", {"name": 2, "id": 1, "extra": 3}, name=["w"], id=[4], extra=[9])
    gone = f"file:{tmp_path}/b-gone.parquet"
    d = data("d.parquet", {"file_path": 2147483546, "pos": 2147483545}, file_path=[a], pos=[1])

    def manifest(name, content, *files, codec="deflate"):
        container(tmp_path / name, ENTRY, [{"status": s, "data_file": {"content": content, "file_path": p, "file_format": "PARQUET", "record_count": n}} for s, p, n in files], codec)
        return {"manifest_path": str(tmp_path / name), "manifest_length": os.path.getsize(tmp_path / name), "partition_spec_id": 0, "content": min(content, 1), "added_snapshot_id": 1, "added_data_files_count": len(files), "existing_data_files_count": 0, "deleted_data_files_count": 0, "partitions": None}

    first = manifest("m1.avro", 0, (1, a, 3))
    container(tmp_path / "l1.avro", LIST, [first])
    container(tmp_path / "l2.avro", LIST, [first, manifest("m2.avro", 0, (1, b, 1), (2, gone, 1), codec="null"), manifest("m3.avro", 1, (1, d, 1))])

    def column(k, name, kind):
        return {"id": k, "name": name, "required": False, "type": kind}

    old = {"type": "struct", "schema-id": 0, "fields": [column(1, "id", "long"), column(2, "old", "string")]}
    new = {"type": "struct", "schema-id": 1, "fields": [column(1, "id", "long"), column(2, "name", "string"), column(3, "extra", "long")]}
    snapshots = [{"snapshot-id": k, "timestamp-ms": 1000 * k, "manifest-list": str(tmp_path / f"l{k}.avro"), "schema-id": k - 1, "summary": {"operation": "append", "n": str(k)}} | ({"parent-snapshot-id": 1} if k == 2 else {}) for k in (1, 2)]
    meta = {"format-version": 2, "schemas": [old, new], "current-schema-id": 1, "current-snapshot-id": 2, "snapshots": snapshots, "snapshot-log": [{"timestamp-ms": 500, "snapshot-id": 7}, {"timestamp-ms": 1000, "snapshot-id": 1}, {"timestamp-ms": 2000, "snapshot-id": 2}]}
    (tmp_path / "v.metadata.json").write_text(json.dumps(meta))
    return tmp_path / "v.metadata.json"


def test_scan(spark, location):
    table = IcebergTable(spark, str(location))
    assert sorted(map(tuple, table.scan().collect())) == [(1, "x", None), (3, "z", None), (4, "w", 9)]
    assert sorted(map(tuple, table.scan(1).select("id", "old").collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_metadata(spark, location):
    table = IcebergTable(spark, str(location))
    assert [(r.snapshot_id, r.parent_id, r.operation, r.summary, r.committed_at.second) for r in table.snapshots().orderBy("snapshot_id").collect()] == [(1, None, "append", {"n": "1"}, 1), (2, 1, "append", {"n": "2"}, 2)]
    assert [(r.snapshot_id, r.is_current_ancestor) for r in table.history().orderBy("made_current_at").collect()] == [(7, False), (1, True), (2, True)]
    assert sorted((r.content, r.added_data_files_count, r.added_delete_files_count) for r in table.metadata("manifests").collect()) == [(0, 1, 0), (0, 2, 0), (1, 0, 1)]
    with pytest.raises(Exception, match="metadata table"):
        table.metadata("buckets")


def test_empty(spark, location):
    meta = json.loads(location.read_text()) | {"current-snapshot-id": -1}
    location.write_text(json.dumps(meta))
    table = IcebergTable(spark, str(location))
    assert table.scan().columns == ["id", "name", "extra"] and table.scan().count() == 0 and table.manifests().count() == 0


def test_not_a_container():
    with pytest.raises(Exception, match="container"):
        list(records(b"nothing"))
