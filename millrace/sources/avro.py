"""Avro container files: records for table manifests, and tables read in stretches of files and written by tasks."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql.text import NotSupported, SqlError

MAGIC = b"Obj\x01"
STRETCH = 64 << 20  # bytes of a file that one task reads
TASKS = 20_000  # tasks of a scan at most; beyond it a task reads several stretches
ROWS = 4096  # records of an Arrow batch, and of a block that is written


def _long(data: BinaryIO) -> int:
    shift = n = 0
    while True:
        byte = data.read(1)[0]
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _blocks(data: BinaryIO) -> Iterator[None]:
    """Once for each item of an array or map; a negative count has a byte size after it."""
    while n := _long(data):
        if n < 0:
            n, _ = -n, _long(data)
        yield from (None for _ in range(n))


def _value(data: BinaryIO, schema: Any, named: dict[str, Any]) -> Any:
    if isinstance(schema, list):
        return _value(data, schema[_long(data)], named)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return _value(data, kind, named)
    if isinstance(schema, dict) and "name" in schema:
        named[schema["name"]] = schema
    match kind:
        case "null":
            return None
        case "boolean":
            return data.read(1) == b"\x01"
        case "int" | "long":
            return _long(data)
        case "float":
            return struct.unpack("<f", data.read(4))[0]
        case "double":
            return struct.unpack("<d", data.read(8))[0]
        case "bytes":
            return data.read(_long(data))
        case "string":
            return data.read(_long(data)).decode("utf-8")
        case "fixed":
            return data.read(schema["size"])
        case "enum":
            return schema["symbols"][_long(data)]
        case "record":
            return {f["name"]: _value(data, f["type"], named) for f in schema["fields"]}
        case "array":
            return [_value(data, schema["items"], named) for _ in _blocks(data)]
        case "map":
            return {_value(data, "string", named): _value(data, schema["values"], named) for _ in _blocks(data)}
    if kind in named:
        return _value(data, named[kind], named)
    raise NotSupported(f"Avro type {kind}")


def _header(data: BinaryIO) -> tuple[Any, str, bytes]:
    """(schema, codec, sync marker); the file then stands at its first block."""
    if data.read(4) != MAGIC:
        raise SqlError("not an Avro container file")
    head = _value(data, {"type": "map", "values": "bytes"}, {})
    return json.loads(head["avro.schema"]), head.get("avro.codec", b"null").decode(), data.read(16)


def _unpacked(block: bytes, codec: str) -> bytes:
    match codec:
        case "null":
            return block
        case "deflate":
            return zlib.decompress(block, -15)
        case "snappy":  # the size stands before the data, as a number without zigzag; four bytes of checksum after it
            size = shift = at = 0
            while True:
                size |= (block[at] & 0x7F) << shift
                if block[at] < 0x80:
                    return pa.Codec("snappy").decompress(block[:-4], size).to_pybytes()
                shift, at = shift + 7, at + 1
        case "bzip2":
            import bz2

            return bz2.decompress(block)
        case "xz":
            import lzma

            return lzma.decompress(block)
        case "zstandard":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    raise NotSupported(f"Avro codec {codec}")


def _records(data: BinaryIO, schema: Any, codec: str, sync: bytes, marker: int, end: int, size: int) -> Iterator[dict[str, Any]]:
    """The records of blocks from the place of the file on, a block in memory at a time; ``marker`` is the place of the
    sync marker before the block, and blocks after a marker at ``end`` or later are another stretch's."""
    named: dict[str, Any] = {}
    while marker < end and data.tell() < size:
        n, block = _long(data), data.read(_long(data))
        own = io.BytesIO(_unpacked(block, codec))
        for _ in range(n):
            yield _value(own, schema, named)
        marker = data.tell()
        if data.read(16) != sync:
            raise SqlError("a block of an Avro file is damaged")


def records(content: bytes) -> Iterator[dict[str, Any]]:
    """The records of a container file."""
    data = io.BytesIO(content)
    schema, codec, sync = _header(data)
    yield from _records(data, schema, codec, sync, 0, len(content), len(content))


# -------------------------------------------------- tables
def _find(data: BinaryIO, wanted: bytes, start: int, end: int) -> int:
    """The first place of the marker that begins from start to before end, else -1."""
    tail, at = b"", start
    data.seek(start)
    while at - len(tail) < end:
        piece = data.read(1 << 16)
        if not piece:
            return -1
        own = tail + piece
        if (k := own.find(wanted)) >= 0:
            found = at - len(tail) + k
            return found if found < end else -1
        at += len(piece)
        tail = own[-(len(wanted) - 1) :]
    return -1


def _store(uri: str):
    """The store of a file and its path there."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _stretch(uri: str, size: int, start: int) -> Iterator[tuple[Any, Iterator[dict[str, Any]]]]:
    """The file's schema and the records of one stretch, if a block begins there."""
    store, path = _store(uri)
    with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as data:
        schema, codec, sync = _header(data)
        end = min(start + STRETCH, size)
        marker = _find(data, sync, start, end)
        if marker >= 0:
            data.seek(marker + len(sync))
            yield schema, _records(data, schema, codec, sync, marker, end, size)


def _adapter(schema: Any, kind: T.DataType, named: dict[str, Any]) -> Callable[[Any], Any]:
    """From a decoded value to what Arrow takes for the table's type; null stays null."""
    if isinstance(schema, list):
        own = [s for s in schema if s != "null"]
        if len(own) > 1:
            raise NotSupported("an Avro union of several types")
        return _adapter(own[0] if own else "null", kind, named)
    if isinstance(schema, str):
        schema = named.get(schema, {"type": schema})
    if isinstance(schema["type"], dict | list):
        return _adapter(schema["type"], kind, named)
    if "name" in schema:
        named[schema["name"]] = schema
    logical = schema.get("logicalType", "")
    match kind:
        case T.NullType():
            return lambda v: None
        case T.StructType():
            found = {f["name"].lower(): f for f in schema["fields"]}
            parts = [(f.name, *((found[f.name.lower()]["name"], _adapter(found[f.name.lower()]["type"], f.dataType, named)) if f.name.lower() in found else ("", None))) for f in kind]
            return lambda v: None if v is None else {n: a(v[own]) if a else None for n, own, a in parts}
        case T.ArrayType():
            item = _adapter(schema["items"], kind.elementType, named)
            return lambda v: None if v is None else [item(x) for x in v]
        case T.MapType():
            value = _adapter(schema["values"], kind.valueType, named)
            return lambda v: None if v is None else [(k, value(x)) for k, x in v.items()]
        case T.DecimalType() if logical == "decimal":
            scale = schema.get("scale", 0)
            return lambda v: None if v is None else Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-scale, WIDE)
        case T.TimestampNTZType() | T.TimestampType() if logical.endswith("timestamp-millis"):
            return lambda v: None if v is None else v * 1000
        case T.StringType() if schema["type"] in ("bytes", "fixed"):
            return lambda v: None if v is None else v.decode("utf-8")
        case T.StringType() if schema["type"] not in ("string", "enum"):
            return lambda v: None if v is None else str(v)
        case T.DoubleType() | T.FloatType() if schema["type"] in ("int", "long"):
            return lambda v: None if v is None else float(v)
    return lambda v: v


def _wide():
    from decimal import Context

    return Context(prec=60)


WIDE = _wide()


def scan(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of all files below some folders, with columns by name in either case; a column that a file lacks is null.

    Spark lists the files; a task reads stretches of them, from the first sync marker in a stretch on, a block in memory
    at a time, so files of any size are dealt to many tasks.  Timestamps keep what the file holds.  Other unions than
    those with null are refused.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).where("length > 0").select("path", "length")
    n = listed.agg(F.sum(F.ceil(F.col("length") / STRETCH))).first()[0] or 0
    if not n:
        return spark.createDataFrame([], schema)
    work = listed.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {STRETCH}L)")).alias("start")).repartition(min(int(n), TASKS))
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for written, own in _stretch(row["path"], row["length"], row["start"]):
                    adapt, rows = _adapter(written, schema, {}), []
                    for r in own:
                        rows.append(adapt(r))
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    return work.mapInArrow(read, schema)


#: Fixed: the container format's names of types.
KINDS = {"boolean": "boolean", "byte": "int", "short": "int", "integer": "int", "long": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes"}
LOGICAL = {"date": ("int", "date"), "timestamp": ("long", "timestamp-micros"), "timestamp_ntz": ("long", "local-timestamp-micros")}


def _schema(kind: T.DataType, name: str = "row") -> Any:
    match kind:
        case T.StructType():
            return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", _schema(f.dataType, f"{name}_{f.name}")]} for f in kind]}
        case T.ArrayType():
            return {"type": "array", "items": ["null", _schema(kind.elementType, f"{name}_item")]}
        case T.MapType(keyType=T.StringType()):
            return {"type": "map", "values": ["null", _schema(kind.valueType, f"{name}_value")]}
        case T.DecimalType():
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if kind.typeName() in LOGICAL:
        return dict(zip(("type", "logicalType"), LOGICAL[kind.typeName()], strict=True))
    if kind.typeName() not in KINDS:
        raise NotSupported(f"writing {kind.simpleString()} as Avro")
    return KINDS[kind.typeName()]


def _number(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _encoded(value: Any, schema: Any) -> bytes:
    if isinstance(schema, list):
        return _number(0) if value is None else _number(1) + _encoded(value, schema[1])
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(schema, dict) and schema.get("logicalType") == "decimal":
        whole = int(value.scaleb(schema["scale"], WIDE))
        value = whole.to_bytes(whole.bit_length() // 8 + 1, "big", signed=True)
    match kind:
        case "boolean":
            return bytes([value])
        case "int" | "long":
            return _number(value)
        case "float":
            return struct.pack("<f", value)
        case "double":
            return struct.pack("<d", value)
        case "bytes":
            return _number(len(value)) + value
        case "string":
            text = value.encode("utf-8")
            return _number(len(text)) + text
        case "record":
            return b"".join(_encoded(value[f["name"]], f["type"]) for f in schema["fields"])
        case "array":
            return (_number(len(value)) + b"".join(_encoded(v, schema["items"]) for v in value) if value else b"") + _number(0)
    pairs = value.items() if isinstance(value, dict) else value
    return (_number(len(value)) + b"".join(_encoded(k, "string") + _encoded(v, schema["values"]) for k, v in pairs) if value else b"") + _number(0)


def _plain(column: pa.Array) -> pa.Array:
    """Days and microseconds as whole numbers."""
    if pa.types.is_date32(column.type):
        return column.view(pa.int32())
    return column.view(pa.int64()) if pa.types.is_timestamp(column.type) else column


def write(df: DataFrame, folder: str) -> int:
    """One container file for each partition that has rows, deflated; the number of rows.

    Each task writes under a hidden name and moves the whole file to its partition's name, so a task that runs again
    replaces its own file.  Dates and timestamps stand in columns of their own, not inside arrays, maps or structs.
    """
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and ("date" in f.dataType.simpleString() or "timestamp" in f.dataType.simpleString()):
            raise NotSupported(f"writing {f.dataType.simpleString()} as Avro")
    schema = _schema(df.schema)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _store(folder)
        name, total, out, sync = f"part-{TaskContext.get().partitionId():06d}.avro", 0, None, uuid.uuid4().bytes
        hidden = f"{path}/_{name}.{uuid.uuid4().hex}"
        for batch in batches:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(hidden)
                head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate"}
                out.write(MAGIC + _encoded(head, {"type": "map", "values": "bytes"}) + sync)
            plain = pa.RecordBatch.from_arrays([_plain(c) for c in batch.columns], names=batch.schema.names)
            for at in range(0, plain.num_rows, ROWS):
                rows = plain.slice(at, ROWS).to_pylist()
                packer = zlib.compressobj(wbits=-15)
                block = packer.compress(b"".join(_encoded(r, schema) for r in rows)) + packer.flush()
                out.write(_number(len(rows)) + _number(len(block)) + block + sync)
                total += len(rows)
        if out is not None:
            out.close()
            store.move(hidden, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    return df.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
