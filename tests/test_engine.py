"""The SQL front door, file catalog and keyed tables."""

import pytest

from millrace.catalogs.base import FileCatalog
from millrace.catalogs.keyed import KeyedCatalog
from millrace.sql.engine import Engine
from millrace.sql.text import NotSupported, SqlError, rewrite, split


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, {"files": FileCatalog({"sf": "/root/testdata/sf0.001"}), "lake": KeyedCatalog(str(tmp_path))})


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_split_and_rewrite():
    assert split("select ';' ; -- x;\n; select /* ; /* n */ ; */ 1") == ["select ';'", "-- x;\n; select /* ; /* n */ ; */ 1".split("; ", 1)[1]]
    assert rewrite("select * from t$snapshots") == "select * from `t$snapshots`"
    assert rewrite("select make_array(1), map {'a': 1}, encode(x, 'hex')") == "select array(1), map('a', 1), lower(hex(x))".replace("map('a', 1)", "map('a', 1)")


def test_query_names(engine):
    assert rows(engine.sql("select count(*) from files.sf.nation n join files.sf.region on n_regionkey = r_regionkey")) == [(25,)]
    engine.sql("use files.sf")
    assert rows(engine.sql("with nation as (select 1 as x) select x from nation")) == [(1,)]
    assert rows(engine.sql("select count(*) from region where r_regionkey in (select n_regionkey from nation)")) == [(5,)]
    assert rows(engine.sql("select p_brand from part qualify row_number() over (order by p_partkey) = 1")) != []
    with pytest.raises(SqlError):
        engine.sql("use files.nope")
    assert (engine.catalog, engine.schema) == ("files", "sf")
    with pytest.raises(SqlError):
        engine.sql("select 1; select 2")
    with pytest.raises(NotSupported):
        engine.sql("merge into a using b on 1 = 1")


def test_show(engine):
    assert rows(engine.sql("show catalogs")) == [("files", "FILES"), ("internal", "INTERNAL"), ("lake", "PAIMON-FS")]
    assert rows(engine.sql("show schemas from files")) == [("sf",)]
    assert rows(engine.sql("show tables from files.sf like '%ion'")) == [("nation",), ("region",)]
    assert ("r_name", "STRING", "Utf8View", "YES") in rows(engine.sql("describe files.sf.region"))
    assert rows(engine.sql("show variables like 'spark.sql.ansi.enabled'"))
    assert "Scan" in rows(engine.sql("explain select * from files.sf.region"))[0][1]


def test_keyed_table(engine):
    engine.script("use catalog lake; create schema if not exists db; use lake.db; create table orders (id int, name string, amount decimal(10,2), dt string) partitioned by (dt) using paimon with ('bucket' = '-1')")
    assert rows(engine.sql("insert into orders values (1, 'alice', 10.50, 'a'), (2, 'bob', 20.25, 'a'), (3, 'carol', 7.00, 'b')")) == [(3,)]
    assert rows(engine.sql("insert overwrite orders values (4, 'dave', 1, 'b')")) == [(1,)]
    assert sorted(rows(engine.sql("select id, dt from orders"))) == [(1, "a"), (2, "a"), (4, "b")]
    assert rows(engine.sql("insert into orders (id, dt) values (9, 'c')")) == [(1,)]
    assert rows(engine.sql("select count(*) from orders$snapshots")) == [(3,)]
    assert rows(engine.sql("select count(*) from orders$partitions")) == [(3,)]
    assert rows(engine.sql("call paimon.create_tag(table => 'orders', tag => 't1')")) == [("OK",)]
    assert rows(engine.sql("select tag_name, snapshot_id from orders$tags")) == [("t1", 3)]
    assert "PARTITIONED BY (`dt`)" in rows(engine.sql("show create table orders"))[0][0]
    engine.sql("create table copy as select id, name from orders where id < 3")
    assert sorted(rows(engine.sql("select * from copy"))) == [(1, "alice"), (2, "bob")]
    engine.sql("create table shape like copy")
    assert rows(engine.sql("select count(*) from shape")) == [(0,)]
    with pytest.raises(SqlError):
        engine.sql("drop schema db")
    engine.sql("drop schema db cascade")
    with pytest.raises(NotSupported):
        engine.sql("create table files.sf.x (id int)")


def test_merge_engines(engine):
    engine.script("create schema lake.m; use lake.m")
    for name, options in (("d", ""), ("f", "'merge-engine' = 'first-row'"), ("p", "'merge-engine' = 'partial-update'"), ("a", "'merge-engine' = 'aggregation', 'fields.v.aggregate-function' = 'sum'")):
        engine.sql(f"create table {name} (id int primary key, v bigint, w string)" + (f" with ({options})" if options else ""))
        engine.sql(f"insert into {name} values (1, 5, 'x')")
        engine.sql(f"insert into {name} values (1, 7, null), (2, 1, 'y')")
    assert sorted(rows(engine.sql("select * from d"))) == [(1, 7, None), (2, 1, "y")]
    assert sorted(rows(engine.sql("select * from f"))) == [(1, 5, "x"), (2, 1, "y")]
    assert sorted(rows(engine.sql("select * from p"))) == [(1, 7, "x"), (2, 1, "y")]
    assert sorted(rows(engine.sql("select * from a"))) == [(1, 12, "x"), (2, 1, "y")]
