"""Sizes and columns that a metastore tells, and commits of several writers."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import types as T

from millrace.catalogs import statistics
from millrace.catalogs.base import FileCatalog
from millrace.catalogs.keyed import KeyedCatalog
from millrace.catalogs.metastore import DictMetastore, Entry, MetastoreCatalog
from millrace.catalogs.statistics import Column, Statistics
from millrace.sources import hive
from millrace.sql.engine import Engine

CLASSES = {v: k for k, v in hive.FORMATS.items()}


def test_properties():
    assert statistics.from_properties({"numRows": " 7 ", "rawDataSize": "9", "totalSize": "3"}) == Statistics(7, 9)
    assert statistics.from_properties({"numRows": "-1", "totalSize": "3"}) == Statistics(None, 3)
    assert statistics.from_properties({"rawDataSize": "x", "totalSize": "3"}) == Statistics()


def test_rows_from_bytes(spark):
    schema = T.StructType.fromDDL("a int, b bigint, c string, d boolean")
    assert statistics.row_width(schema) == 4 + 8 + 16 + 16
    assert [statistics.estimated_rows(schema, n) for n in (0, 1, 440)] == [0, 1, 10]
    assert statistics.from_files(Statistics(5, None), schema, [44, 44], False) == Statistics(5, 88)
    assert statistics.from_files(Statistics(5, 6), schema, [44, 44], True) == Statistics(2, 88)


def test_columns(spark):
    kind = T.StructType.fromDDL("t tinyint, l bigint, f float, p decimal(4,2), d date, ts timestamp_ntz, b boolean, s string, x binary")
    told = {
        "t": ({"type": "LONG", "nulls": 1, "distinct": 2, "low": -128, "high": 128}, Column(1, 2, -128, None)),
        "l": ({"type": "LONG", "nulls": -1, "distinct": 2, "low": 1, "high": 2}, Column(None, 2, 1, 2)),
        "f": ({"type": "DOUBLE", "nulls": 0, "distinct": 1, "low": -1.5, "high": 1e39}, Column(0, 1, -1.5, None)),
        "p": ({"type": "DECIMAL", "nulls": 0, "distinct": 1, "low": "99.99", "high": "100"}, Column(0, 1, Decimal("99.99"), None)),
        "d": ({"type": "DATE", "nulls": 0, "distinct": 1, "low": dt.date(2024, 1, 1), "high": 3}, Column(0, 1, dt.date(2024, 1, 1), None)),
        "b": ({"type": "BOOLEAN", "nulls": 3, "trues": 4, "falses": 0}, Column(3, 1, True, True)),
        "s": ({"type": "STRING", "nulls": 0, "distinct": 9}, Column(0, 9)),
        "x": ({"type": "STRING", "nulls": 0, "distinct": 9}, Column()),
    }
    assert {n: statistics.column(t, kind[n].dataType) for n, (t, _) in told.items()} == {n: want for n, (_, want) in told.items()}


def test_requests_and_cache(spark):
    schema, asked, now = T.StructType.fromDDL(", ".join(f"c{k} int" for k in range(250))), [], [0.0]

    def ask(names):
        asked.append(len(names))
        if "c249" in names:
            raise OSError
        return {n: {"type": "LONG", "nulls": 0} for n in names}

    found, complete = statistics.columns(ask, schema)
    assert sorted(asked) == [50, 100, 100] and len(found) == 200 and not complete
    cache, loads = statistics.Cache(10, lambda: now[0]), []

    def load(full):
        return lambda: (loads.append(1), (Statistics(len(loads)), full))[1]

    assert cache.get("t", schema, load(False)).rows == 1
    assert cache.get("t", schema, load(True)).rows == 2 == cache.get("t", schema, load(True)).rows
    assert cache.get("t", T.StructType.fromDDL("a int"), load(True)).rows == 3
    now[0] = 10.0
    assert cache.get("t", T.StructType.fromDDL("a int"), load(True)).rows == 4


def test_of_tables(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 4 as dt").write.partitionBy("dt").parquet(f"{tmp_path}/p")
    spark.range(3).write.parquet(f"{tmp_path}/u")
    kind = CLASSES["parquet"]
    entries = {"p": Entry(f"{tmp_path}/p", [("id", "bigint")], [("dt", "int")], *kind, parameters={"numRows": "40", "totalSize": "5"}), "u": Entry(f"{tmp_path}/u", [("id", "bigint")], [], *kind, column_statistics={"id": {"type": "LONG", "nulls": 0, "distinct": 3, "low": 0, "high": 2}})}
    catalog = MetastoreCatalog(DictMetastore({"db": entries}))
    assert catalog.statistics(spark, "db", "p") == Statistics(40, 5)
    pruned = catalog.statistics(spark, "db", "p", "dt = 1")
    size = sum(f["file_size"] for f in hive.data_files(spark, hive.Table(f"{tmp_path}/p/dt=1", [])).collect())
    assert pruned == Statistics(size // 12, size)
    assert catalog.statistics(spark, "db", "u").columns == {"id": Column(0, 3, 0, 2)}


def test_writers_at_the_same_time(spark, tmp_path):
    engine = Engine(spark, {"files": FileCatalog({"sf": "/root/testdata/sf0.001"}), "lake": KeyedCatalog(str(tmp_path))})
    engine.script("use catalog lake; create schema db; use lake.db; create table t (id int); create table b (id int primary key) with ('bucket' = '3')")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: engine.sql(f"insert into t values ({k})"), range(8)))
    assert sorted(r[0] for r in engine.sql("select * from t").collect()) == list(range(8))
    assert [r[0] for r in engine.sql("select snapshot_id from t$snapshots order by 1").collect()] == list(range(1, 9))
    engine.sql("insert into b select o_custkey from (select distinct cast(c_custkey as int) as o_custkey from files.sf.customer)")
    told = {r["bucket"]: r["file_count"] for r in engine.sql("select * from b$buckets").collect()}
    assert told == {0: 1, 1: 1, 2: 1}
    by_row = spark.read.parquet(*[r[0] for r in engine.sql("select file_path from b$data_files").collect()]).selectExpr("cast(regexp_extract(input_file_name(), 'part-([0-9]+)', 1) as int) as f", "pmod(hash(id), 3) as h").distinct().collect()
    assert sorted(tuple(r) for r in by_row) == [(0, 0), (1, 1), (2, 2)]
