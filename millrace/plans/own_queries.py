"""Queries written with the engine's own operators, sources and front end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs.base import FileCatalog
from ..catalogs.keyed import KeyedCatalog
from ..operators import merge
from ..sources import avro, hive
from ..sql.engine import Engine

SEQUENCE = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, {"files": FileCatalog({"sf": sf_dir})})
    engine.sql("use files.sf")
    return engine


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/millrace-scan-{uuid.uuid4().hex}"


def _lake(spark: SparkSession, sf_dir: str, *statements: str) -> Engine:
    """An engine over a new warehouse with schema ``lake.db`` in use, after some statements."""
    engine = Engine(spark, {"files": FileCatalog({"sf": sf_dir}), "lake": KeyedCatalog(_folder(spark))})
    engine.script("use catalog lake; create schema db; use lake.db")
    for s in statements:
        engine.script(s)
    return engine


def _on_files(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir).sql(text)


def _on_lake(text: str, *statements: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _lake(spark, sf_dir, *statements).sql(text)


def lake_show_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW CREATE TABLE without the folder's name, which is new each time."""
    return _on_lake("show create table t", _NATIONS)(spark, sf_dir).select(F.regexp_replace("definition", "LOCATION '[^']*'", "LOCATION ''").alias("definition"))


_NATIONS = "create table t (k int not null, name string, region int) partitioned by (region) using paimon with ('bucket' = '-1', 'file.format' = 'parquet')"
_FILL = "insert into t select n_nationkey, n_name, n_regionkey from files.sf.nation"
_KEYED = "create table c (k bigint primary key, price decimal(10, 2)) with ('merge-engine' = 'deduplicate')"
_QUALIFY = "select p_brand, max(p_partkey) as m from (select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 3) group by p_brand"
_NULLS = "select c_custkey, row_number() over (partition by c_mktsegment order by x{0}, c_custkey) as up, row_number() over (partition by c_mktsegment order by x desc{1}, c_custkey) as down from (select *, case when c_custkey % 3 = 0 then null else c_nationkey end as x from customer)"
_REGION = "select * from (values ('r_regionkey', 'INT', 'Int32', 'YES'), ('r_name', 'STRING', 'Utf8View', 'YES')) t(column_name, sql_type, data_type, is_nullable)"
_DEFINITION = """CREATE TABLE `lake`.`db`.`t`
(
`k` INT NOT NULL,
`name` STRING,
`region` INT
)
PARTITIONED BY (`region`)
USING PAIMON
LOCATION ''
WITH (
'bucket' = '-1',
'file.format' = 'parquet'
)"""

#: Statements of the engine, those on ``lake`` over a warehouse made for each, with what DuckDB has to give.
STATEMENTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "engine_subscript": (_on_files("select n_nationkey, make_array(n_name, 'x')[1] as a, make_array(1, 2)[3] as b, split(n_name, '_')[2] as c, make_array(1, 2)[n_regionkey] as d from nation"), "select n_nationkey, n_name as a, cast(null as int) as b, nullif(split_part(n_name, '_', 2), '') as c, case n_regionkey when 1 then 1 when 2 then 2 end as d from nation"),
    "engine_null_order": (_on_files(_NULLS.format("", "")), _NULLS.format(" nulls last", " nulls first")),
    "engine_count_name": (_on_files("select c_mktsegment, count(*) from customer group by c_mktsegment"), 'select c_mktsegment, count(*) as "count(*)" from customer group by c_mktsegment'),
    "engine_qualify_inner": (_on_files(_QUALIFY), _QUALIFY),
    "engine_decode": (_on_files("select n_nationkey, encode(decode(base64(cast(n_name as binary)), 'base64'), 'hex') as h, \"encode(x, 'hex')\" as s from nation"), "select n_nationkey, lower(hex(n_name)) as h, 'encode(x, ''hex'')' as s from nation"),
    "engine_numbers": (_on_files("select c_custkey, gcd(c_custkey, 36) as g, lcm(c_custkey, 6) as l, trunc(c_acctbal) as t, trunc(c_acctbal, 1) as u from customer"), "select c_custkey, gcd(c_custkey, 36) as g, lcm(c_custkey, 6) as l, trunc(c_acctbal) as t, trunc(c_acctbal * 10) / 10 as u from customer"),
    "engine_regexp_match": (_on_files("select n_nationkey, array_to_string(regexp_match(n_name, '([A-Z]+)_([0-9]+)'), '-') as a, regexp_match(n_name, '1[0-9]')[1] as b from nation"), "select n_nationkey, replace(n_name, '_', '-') as a, nullif(regexp_extract(n_name, '1[0-9]'), '') as b from nation"),
    "engine_to_char": (_on_files("select o_orderkey, to_char(o_orderdate, '%Y-%m-%dT%H:%M:%S (%j)') as t from orders"), "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S (%j)') as t from orders"),
    "engine_arrow_types": (_on_files("select n_nationkey, arrow_typeof(n_regionkey) as a, arrow_typeof(make_array(n_name)) as b, arrow_cast(n_regionkey, 'Int64') as c, arrow_typeof(arrow_cast(n_regionkey, 'Decimal128(10, 2)')) as d from nation"), "select n_nationkey, 'Int32' as a, 'List(Utf8View)' as b, cast(n_regionkey as bigint) as c, 'Decimal128(10, 2)' as d from nation"),
    "describe_table": (_on_files("describe region"), _REGION),
    "show_schemas": (_on_files("show schemas from files"), "select 'sf' as schema_name"),
    "lake_insert": (_on_lake("select * from t", _NATIONS, _FILL, "insert into t (name, k, region) values (null, 99, 1)"), "select n_nationkey as k, n_name as name, n_regionkey as region from nation union all select 99, null, 1"),
    "lake_insert_count": (_on_lake(_FILL, _NATIONS), "select count(*) as count from nation"),
    "lake_overwrite": (_on_lake("select * from t", _NATIONS, _FILL, "insert overwrite t select n_nationkey, 'new', n_regionkey from files.sf.nation where n_regionkey = 2"), "select n_nationkey as k, case when n_regionkey = 2 then 'new' else n_name end as name, n_regionkey as region from nation"),
    "lake_ctas": (_on_lake("select * from made", "create table made as select o_custkey, count(*) as n from files.sf.orders group by o_custkey"), "select o_custkey, count(*) as n from orders group by o_custkey"),
    "lake_like": (_on_lake("describe made", "create table made like files.sf.region"), _REGION),
    "lake_upsert": (_on_lake("select * from c", _KEYED, "insert into c select o_custkey, count(*) from files.sf.orders group by o_custkey", "insert into c select c_custkey, 0 from files.sf.customer where c_custkey % 2 = 0"), "select coalesce(o_custkey, c_custkey) as k, cast(case when c_custkey is not null then 0 else p end as decimal(10, 2)) as price from (select o_custkey, count(*) as p from orders group by o_custkey) full join (select c_custkey from customer where c_custkey % 2 = 0) on o_custkey = c_custkey"),
    "lake_drop": (_on_lake("show tables", _NATIONS, _KEYED, "drop table c; drop table if exists c"), "select 't' as table_name"),
    "lake_drop_schema": (_on_lake("show schemas from lake", _NATIONS, "create schema other; create schema if not exists other; drop schema db cascade"), "select 'other' as schema_name"),
    "lake_options": (_on_lake("select * from t$options", _NATIONS), "select * from (values ('bucket', '-1'), ('file.format', 'parquet')) t(key, value)"),
    "lake_snapshots": (_on_lake("select snapshot_id, commit_kind, delta_record_count from t$snapshots", _NATIONS, _FILL, _FILL), "select i as snapshot_id, 'APPEND' as commit_kind, n as delta_record_count from (select unnest([1, 2]) as i), (select count(*) as n from nation)"),
    "lake_tags": (_on_lake("select * from t$tags", _NATIONS, _FILL, "call paimon.create_tag(table => 'db.t', tag => 'one'); call paimon.create_tag(table => 'db.t', tag => 'two')", "call paimon.delete_tag(table => 'db.t', tag => 'two')"), "select 'one' as tag_name, 1 as snapshot_id, count(*) as record_count from nation"),
    "lake_schemas": (_on_lake("select schema_id, partition_keys, primary_keys from t$schemas", _NATIONS), "select 0 as schema_id, '[\"region\"]' as partition_keys, '[]' as primary_keys"),
    "lake_partitions": (_on_lake("select partition, count(*) as n from t$data_files group by partition", _NATIONS, _FILL), "select 'region=' || n_regionkey as partition, cast(1 as bigint) as n from nation group by n_regionkey"),
    "lake_audit_log": (_on_lake("select rowkind, count(*) as n from c$audit_log group by rowkind", _KEYED, "insert into c select c_custkey, 1 from files.sf.customer", "insert into c select c_custkey, 2 from files.sf.customer"), "select '+I' as rowkind, 2 * count(*) as n from customer"),
    "lake_show_create": (lake_show_create, "select '" + _DEFINITION.replace("'", "''") + "' as definition"),
}


def merge_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.expr("cast(case when event_id % 50 = 0 then 2 when event_id % 7 = 0 then null else 1 end as bigint)").alias("p"))
    return merge.aggregation(rows, ["user_id"], SEQUENCE, {"p": "product"}).drop("ts", "event_id")


def merge_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.deduplicate(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], SEQUENCE).drop("ts")


def merge_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_row(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], SEQUENCE).drop("ts")


def merge_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("user_id", "ts", "event_id", "case when event_type = 'purchase' then value end as paid", "case when event_type = 'view' then event_id end as viewed")
    return merge.partial_update(rows, ["user_id"], SEQUENCE).drop("ts")


def merge_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"sum": "s", "min": "lo", "max": "hi", "last_value": "l", "first_value": "f", "last_non_null_value": "ln", "first_non_null_value": "fn", "bool_and": "ba", "bool_or": "bo", "listagg": "la"}
    x = F.expr("case when event_type <> 'click' then event_id end")
    flag = F.expr("value > 50")
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", *[(flag if f.startswith("bool") else x.cast("string") if f == "listagg" else x).alias(n) for f, n in names.items()])
    return merge.aggregation(rows, ["user_id"], SEQUENCE, {n: f for f, n in names.items()}).drop("ts")


def engine_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("with nation as (select n_nationkey, n_regionkey from files.sf.nation) select r_name, count(*) as n from nation join sf.region on n_regionkey = r_regionkey where exists (select 1 from customer where c_nationkey = n_nationkey) group by r_name")


def engine_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 2")


def engine_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("select n_nationkey, strpos(n_name, '_') as p, encode(cast(n_name as binary), 'hex') as h, map {'k': n_name}['k'] as m, array_to_string(make_array('a', n_name), '-') as j from nation")


def show_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("show catalogs")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("show tables like '%ion'")


def _round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _folder(spark)
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_orderpriority", "cast(o_totalprice as decimal(12,2)) as price", "o_orderstatus")
        if kind == "textfile":
            rows.write.option("sep", "\u0001").option("nullValue", hive.NULL_TEXT).partitionBy("o_orderstatus").csv(at)
        elif kind == "avro":
            for status in "FOP":  # the values of the column
                avro.write(rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), f"{at}/o_orderstatus={status}")
        else:
            rows.write.format(kind).partitionBy("o_orderstatus").save(at)
        table = hive.Table(at, [("o_orderkey", "bigint"), ("o_orderpriority", "string"), ("price", "decimal(12,2)"), ("missing", "int")], kind, [("o_orderstatus", "string")])
        return hive.scan(spark, table, "o_orderstatus in ('O', 'P')").select("o_orderkey", "o_orderpriority", F.col("price").cast("double").alias("price"), "missing", "o_orderstatus")

    return query


def meta_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus").repartition(1).write.partitionBy("o_orderstatus").parquet(at)
    return hive.partitions(spark, hive.Table(at, [("o_orderkey", "bigint")], "parquet", [("o_orderstatus", "string")])).select("partition", "data_file_count")


_LAST = "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts {0}, event_id {0}) as rn from events) where rn = 1"
_SCAN = "select o_orderkey, o_orderpriority, cast(cast(o_totalprice as decimal(12, 2)) as double) as price, cast(null as int) as missing, o_orderstatus from orders where o_orderstatus in ('O', 'P')"
_NUMBERED = "(select *, row_number() over (order by ts, event_id) as o, case when event_type <> 'click' then event_id end as x from events)"

ORACLE = {
    "merge_deduplicate": _LAST.format("desc"),
    "merge_first_row": _LAST.format("asc"),
    "merge_partial_update": f"select user_id, arg_max(event_id, o) as event_id, arg_max(value, o) filter (where event_type = 'purchase') as paid, arg_max(event_id, o) filter (where event_type = 'view') as viewed from {_NUMBERED} group by user_id",
    "merge_aggregation": f"select user_id, arg_max(event_id, o) as event_id, cast(sum(x) as bigint) as s, min(x) as lo, max(x) as hi, arg_max_null(x, o) as l, arg_min_null(x, o) as f, arg_max(x, o) filter (where x is not null) as ln, arg_min(x, o) filter (where x is not null) as fn, bool_and(value > 50) as ba, bool_or(value > 50) as bo, coalesce(string_agg(cast(x as varchar), ',' order by o) filter (where x is not null), '') as la from {_NUMBERED} group by user_id",
    "engine_names": "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey where exists (select 1 from customer where c_nationkey = n_nationkey) group by r_name",
    "engine_qualify": "select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 2",
    "engine_functions": "select n_nationkey, cast(strpos(n_name, '_') as int) as p, lower(hex(n_name)) as h, n_name as m, 'a-' || n_name as j from nation",
    "show_catalogs": "select * from (values ('files', 'FILES'), ('internal', 'INTERNAL')) t(catalog_name, catalog_type)",
    "show_tables": "select * from (values ('nation'), ('region')) t(table_name)",
    "merge_product": "select user_id, cast(case when count(case when event_id % 50 = 0 or event_id % 7 <> 0 then 1 end) > 0 then pow(2, count(case when event_id % 50 = 0 then 1 end)) end as bigint) as p from events group by user_id",
    "scan_text": _SCAN,
    "scan_parquet": _SCAN,
    "scan_orc": _SCAN,
    "scan_avro": _SCAN,
    "meta_partitions": "select 'o_orderstatus=' || o_orderstatus as partition, cast(1 as bigint) as data_file_count from orders group by o_orderstatus",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [merge_deduplicate, merge_first_row, merge_partial_update, merge_aggregation, engine_names, engine_qualify, engine_functions, show_catalogs, show_tables, meta_partitions, merge_product]
    return {f.__name__: f for f in own} | {"scan_text": _round_trip("textfile"), "scan_parquet": _round_trip("parquet"), "scan_orc": _round_trip("orc"), "scan_avro": _round_trip("avro")} | {name: query for name, (query, _) in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {name: text for name, (_, text) in STATEMENTS.items()}
