"""Metastore types, text tables, partitions and transaction logs."""

import json

import pytest

from millrace.sources import delta, hive
from millrace.sources.hive_types import parse_type
from millrace.sql.text import NotSupported


def test_types():
    assert parse_type("array<struct<skuId:string,qty:int>>").simpleString() == "array<struct<skuId:string,qty:int>>"
    assert parse_type("decimal").simpleString() == "decimal(10,0)" and parse_type("varchar(5)").simpleString() == "string"
    assert parse_type("map<string,decimal(5,2)>").simpleString() == "map<string,decimal(5,2)>"
    for bad in ("decimal(39,0)", "decimal(5, 2)", "array<int", "nope", "int x"):
        with pytest.raises(ValueError):
            parse_type(bad)


def test_text_table(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|x|2.5\n2|NULL|bad\n3\n")
    t = hive.Table(str(tmp_path), [("id", "int"), ("name", "string"), ("amount", "decimal(5,2)")], "textfile", options={"field.delim": "|", "serialization.null.format": "NULL"})
    assert [(r[0], r[1], r[2] and float(r[2])) for r in hive.scan(spark, t).orderBy("id").collect()] == [(1, "x", 2.5), (2, None, None), (3, None, None)]
    with pytest.raises(NotSupported):
        hive.text_options({"skip.header.line.count": "2"})


@pytest.mark.parametrize("kind", ["parquet", "orc"])
def test_partitions(spark, tmp_path, kind):
    at = str(tmp_path / "t")
    spark.range(6).selectExpr("cast(id as int) as Id", "if(id < 4, concat('d', id % 2), null) as dt").write.partitionBy("dt").format(kind).save(at)
    t = hive.Table(at, [("id", "bigint"), ("extra", "string")], kind, [("dt", "string")])
    assert sorted(tuple(r) for r in hive.scan(spark, t, "dt = 'd1'").collect()) == [(1, None, "d1"), (3, None, "d1")]
    assert hive.scan(spark, t).where("dt is null").count() == 2
    assert hive.scan(spark, t, "dt = 'none'").count() == 0
    assert {r["partition"] for r in hive.partitions(spark, t).collect()} == {"dt=d0", "dt=d1", "dt=__HIVE_DEFAULT_PARTITION__"}
    assert hive.data_files(spark, t).count() >= 3


def test_transaction_log(spark, tmp_path):
    at = tmp_path / "d"
    spark.range(3).coalesce(1).write.parquet(str(at))
    first = next(p.name for p in at.glob("part-*"))
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(str(at))
    second = next(p.name for p in at.glob("part-*") if p.name != first)
    (at / "_delta_log").mkdir()
    schema = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]})
    add = [{"add": {"path": p, "partitionValues": {}, "size": 1}} for p in (first, second)]
    (at / "_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, [{"metaData": {"schemaString": schema, "partitionColumns": []}}, add[0]])))
    assert sorted(r[0] for r in delta.read(spark, str(at)).collect()) == [0, 1, 2]
    (at / "_delta_log" / f"{1:020d}.json").write_text("\n".join(map(json.dumps, [add[1], {"remove": {"path": first}}])))
    assert sorted(r[0] for r in delta.read(spark, str(at)).collect()) == [10, 11]
