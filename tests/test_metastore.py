"""Tables of a metastore by SQL: each format, metadata tables, refusals."""

import json

import pytest

from millrace.catalogs.metastore import DictMetastore, MetastoreCatalog
from millrace.sources import hive
from millrace.sql.engine import Engine
from millrace.sql.text import NotSupported, SqlError

CLASSES = {v: k for k, v in hive.FORMATS.items()}


@pytest.fixture
def engine(spark, tmp_path):
    spark.range(9).selectExpr("cast(id as int) id", "concat('d', id % 3) dt").write.partitionBy("dt").parquet(f"{tmp_path}/p")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("1\tx\n2\t\\N\n")
    spark.range(4).write.parquet(f"{tmp_path}/d")
    log = tmp_path / "d" / "_delta_log"
    log.mkdir()
    files = sorted(p.name for p in (tmp_path / "d").glob("*.parquet"))
    schema = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]})
    lines = [{"metaData": {"schemaString": schema, "partitionColumns": [], "configuration": {}}}, *({"add": {"path": f, "partitionValues": {}, "size": 1}} for f in files)]
    (log / f"{0:020d}.json").write_text("\n".join(map(json.dumps, lines)))
    entries = {"db": {
        "p": {"location": f"{tmp_path}/p", "columns": [["id", "int"]], "partition_columns": [["dt", "string"]], "input_format": CLASSES["parquet"][0], "serde": CLASSES["parquet"][1]},
        "t": {"location": f"{tmp_path}/t", "columns": [["id", "int"], ["s", "string"]], "input_format": CLASSES["textfile"][0], "serde": CLASSES["textfile"][1], "serde_parameters": {"field.delim": "\\t"}},
        "d": {"location": f"{tmp_path}/d", "parameters": {"spark.sql.sources.provider": "delta"}},
        "v": {"location": "", "table_type": "MATERIALIZED_VIEW"},
        "h": {"location": "", "input_format": "org.apache.hudi.hadoop.HoodieParquetInputFormat"},
    }}
    (tmp_path / "meta.json").write_text(json.dumps(entries))
    e = Engine(spark, {"hms": MetastoreCatalog(DictMetastore.read(spark, f"file://{tmp_path}/meta.json"))})
    e.sql("use hms.db")
    return e


def test_formats(engine):
    assert [tuple(r) for r in engine.sql("select id, dt from p where dt = 'd1' order by id").collect()] == [(1, "d1"), (4, "d1"), (7, "d1")]
    assert [tuple(r) for r in engine.sql("select * from hms.db.t order by id").collect()] == [(1, "x"), (2, None)]
    assert engine.sql("select count(*) as n from d").first()["n"] == 4
    assert [r[0] for r in engine.sql("select partition from p$partitions order by partition").collect()] == ["dt=d0", "dt=d1", "dt=d2"]
    assert engine.sql("select * from p$data_files").count() >= 3
    assert [r[0] for r in engine.sql("show tables").collect()] == ["d", "h", "p", "t", "v"]
    assert engine.sql("show create table p").first()[0].startswith("CREATE TABLE `hms`.`db`.`p`\n(\n`id` INT,\n`dt` STRING\n)\nPARTITIONED BY (`dt`)")


def test_pruned_scan(engine):
    plan = engine.sql("explain select id from p where dt = 'd1'").first()["plan"]
    assert "PartitionFilters: [isnotnull(dt" in plan and "ReadSchema: struct<id:int>" in plan


def test_refusals(engine):
    for text, kind in (("select * from v", NotSupported), ("select * from h", NotSupported), ("select * from d$data_files", NotSupported), ("select * from p$snapshots", NotSupported), ("select * from none", SqlError), ("insert into p select 1, 'x'", NotSupported)):
        with pytest.raises(kind):
            engine.sql(text)


def test_deletion_vectors_are_refused(engine, tmp_path):
    (tmp_path / "d" / "_delta_log" / f"{1:020d}.json").write_text(json.dumps({"add": {"path": "x.parquet", "partitionValues": {}, "size": 1, "deletionVector": {"storageType": "u"}}}))
    with pytest.raises(NotSupported):
        engine.sql("select * from d")


def test_delimiters():
    for raw, want in (("\\t", "\t"), ("\\001", "\x01"), ("\\u0001", "\x01"), ("0x7c", "|"), ("9", "\t"), ("-2", "\xfe"), ("|x", "|"), ("a", "a")):
        assert hive.delimiter(raw) == want
    assert hive.text_options({"serialization.format": "1"})[0] == "\x01" and hive.text_options({"field.delim": ",", "serialization.format": "1"})[0] == ","
    with pytest.raises(SqlError):
        hive.text_options({"skip.header.line.count": "x"})
