"""Configuration, tables, CSV, scripts and the prompt."""

import io

import pytest

from millrace import cli, config
from millrace.sql.engine import Engine

TEXT = """
[server]
memory-limit = "4GB"
[[catalog.tpch]]
name = "gen"
[[catalog.files]]
name = "files"
schemas = { sf = "/root/testdata/sf0.001" }
[[catalog.hms]]
name = "store"
metastore-uri = "127.0.0.1:9083"
s3-storage = { region = "r", access-key = "a", secret-key = "b", path-style-access = true }
[[catalog.paimon-fs]]
name = "lake"
warehouse = "s3://bucket/w"
s3-storage = { access-key = "own" }
"""


def test_config():
    c = config.load(TEXT)
    assert (c.memory_limit, c.port, sorted(c.catalogs)) == (4 << 30, 32010, ["files", "gen", "lake", "store"])
    assert c.hadoop == {"fs.s3a.endpoint.region": "r", "fs.s3a.access.key": "a", "fs.s3a.secret.key": "b", "fs.s3a.path.style.access": "true", "fs.s3a.bucket.bucket.access.key": "own"}
    assert [config.memory(x) for x in ("7", "2k", "1 MB", "1t")] == [7, 2048, 1 << 20, 1 << 40]


@pytest.mark.parametrize("text", ["x = 1", "[server]\nport = 1", '[[catalog.tpch]]\nname = "a"\nmore = 1', '[[catalog.tpch]]\nname = "a"\n[[catalog.tpcds]]\nname = "a"', '[[catalog.hms]]\nname = "a"', '[[catalog.odd]]\nname = "a"', '[[catalog.tpch]]\nname = "internal"', '[server]\nmemory-limit = "4 parsecs"', "[server", '[[catalog.glue]]\nname = "g"\noss-storage = { access-key = "k" }'])
def test_config_refused(text):
    with pytest.raises(Exception, match=r"unknown|lacks|two catalogs|not a size|configuration"):
        config.load(text)


def test_table():
    assert cli.table(["a", "name"], [(1, "x"), (None, "中")]) == "+---+------+\n| a | name |\n+---+------+\n| 1 | x    |\n|   | 中   |\n+---+------+"
    assert cli.table(["a"], [(True,), (b"\x01",)], box=True) == "╭──────╮\n│ a    │\n╞══════╡\n│ true │\n├──────┤\n│ 01   │\n╰──────╯"
    assert cli.table([], []) == ""


def test_csv(spark):
    assert cli.to_csv(spark.sql("select 1 as a, 'x,\"y' as b union all select null, ''")) in ('﻿a,b\r\n1,"x,""y"\r\n,\r\n',)


def test_script_and_prompt(spark):
    engine, out = Engine(spark, config.load(TEXT).catalogs), io.StringIO()
    cli.run(engine, "use files.sf; select count(*) as n from region;", out)
    assert "| n |" in out.getvalue() and "| 5 |" in out.getvalue() and "0 row(s) fetched." in out.getvalue()
    out = io.StringIO()
    cli.prompt(engine, io.StringIO("select *\nfrom nowhere;\nshow schemas from store;\nshow catalogs;\nquit;\nselect 1;\n"), out)
    said = out.getvalue()
    assert said.count("Error:") == 2 and "│ gen          │ TPCH" in said and "5 row(s) fetched." in said
