"""The generated catalog."""

import pytest

from millrace.catalogs.generated import NATIONS, ROWS, TpchCatalog
from millrace.sql.engine import Engine
from millrace.sql.text import NotSupported


def test_tables(spark):
    engine = Engine(spark, {"tpch": TpchCatalog()})
    engine.sql("use tpch.sf1")
    for table, n in ROWS.items():
        assert engine.sql(f"select count(*) from {table}").first()[0] == n
        engine.sql(f"select * from {table} limit 3").collect()
    assert [f"{r[0].strip()} {r[1]}" for r in engine.sql("select n_name, n_regionkey from nation order by n_nationkey").collect()] == NATIONS.split(",")
    assert engine.sql("select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)").first()[0] == 0
    assert engine.sql("select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)").first()[0] == 0
    assert engine.sql("select count(*) from (select 1 from partsupp group by ps_partkey, ps_suppkey having count(*) > 1)").first()[0] == 0
    with pytest.raises(NotSupported):
        engine.sql("insert into region values (1, 'x', 'y')")
