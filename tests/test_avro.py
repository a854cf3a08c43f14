"""Avro tables: types, stretches, codecs, columns by name."""

import datetime as dt
import io
import json
import zlib
from decimal import Decimal

import pyarrow as pa
import pytest

from millrace.sources import avro, hive
from millrace.sql.text import NotSupported

DDL = "id int, tiny tinyint, small smallint, big bigint, r float, x double, flag boolean, amount decimal(10,2), wide decimal(38,0), fraction decimal(38,18), name string, b binary, day date, ts timestamp_ntz, tags array<string>, attrs map<string,int>, ship struct<zip:string,lines:array<struct<sku:string,qty:int>>>"
ROWS = [
    (1, -128, -32768, -(2**63), -1.5, -2.25, True, Decimal("-10.50"), Decimal("-" + "9" * 38), Decimal("-12345678901234567890.123456789012345678"), "中文", b"\x00\xff", dt.date(1960, 1, 2), dt.datetime(1960, 1, 2, 3, 4, 5, 123000), ["a", None], {"x": 1, "y": None}, {"zip": "10001", "lines": [{"sku": "s", "qty": 1}, None]}),
    (2, 127, 32767, 2**63 - 1, 1.5, 2.25, False, Decimal("99999999.99"), Decimal("9" * 38), Decimal("0"), "", b"", dt.date(2000, 2, 29), dt.datetime(2000, 2, 29), [], {}, {"zip": None, "lines": []}),
    (3, *[None] * 16),
]


def plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r["id"])


def test_types_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DDL)
    assert avro.write(df.repartition(2), f"file://{tmp_path}/a") == 3
    assert plain(avro.scan(spark, [f"{tmp_path}/a"], df.schema).collect()) == plain(df.collect())


def test_stretches_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(avro, "ROWS", 50)
    rows = [{"id": k} for k in range(1000)]
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}]}
    sync, out = b"0123456789abcdef", io.BytesIO()
    out.write(avro.MAGIC + avro._encoded({"avro.schema": json.dumps(schema).encode()}, {"type": "map", "values": "bytes"}) + sync)
    for k in range(0, 1000, 50):
        block = b"".join(avro._encoded(r, schema) for r in rows[k : k + 50])
        out.write(avro._number(50) + avro._number(len(block)) + block + sync)
    (tmp_path / "f.avro").write_bytes(out.getvalue())
    size = len(out.getvalue())
    for step in (1, 7, 16, 100, 333, size):
        monkeypatch.setattr(avro, "STRETCH", step)
        got = [r["id"] for start in range(0, size, step) for _, own in avro._stretch(f"{tmp_path}/f.avro", size, start) for r in own]
        assert got == list(range(1000)), step


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "bzip2", "xz", "zstandard"])
def test_codecs(codec):
    import bz2
    import lzma

    import zstandard

    data = b"some block " * 100
    pack = {"null": lambda b: b, "deflate": lambda b: zlib.compress(b)[2:-4], "snappy": lambda b: pa.Codec("snappy").compress(b, asbytes=True) + b"crc!", "bzip2": bz2.compress, "xz": lzma.compress, "zstandard": zstandard.compress}
    assert avro._unpacked(pack[codec](data), codec) == data


def test_other_columns(spark, tmp_path):
    avro.write(spark.sql("select 7 as UserId, named_struct('Value', 5, 'Label', 'l') as Info, 'd' as extra"), f"{tmp_path}/t/dt=2024-01-02")
    table = hive.Table(f"{tmp_path}/t", [("info", "struct<label:string,value:bigint>"), ("userid", "bigint"), ("missing", "string")], "avro", [("dt", "date")])
    assert hive.scan(spark, table).first().asDict(recursive=True) == {"info": {"label": "l", "value": 5}, "userid": 7, "missing": None, "dt": dt.date(2024, 1, 2)}
    assert hive.scan(spark, table, "dt > date'2025-01-01'").count() == 0
    assert avro.write(spark.range(0), f"{tmp_path}/none") == 0


def test_millis_and_refusals(spark):
    own = avro._adapter(["null", {"type": "long", "logicalType": "timestamp-millis"}], hive.parse_type("timestamp"), {})
    assert own(-1) == -1000 and own(None) is None
    with pytest.raises(NotSupported):
        avro._adapter(["null", "int", "string"], hive.parse_type("string"), {})
    with pytest.raises(NotSupported):
        avro._unpacked(b"", "none")
