"""Generated TPC-H tables: schemas sf1 to sf1000 select the scale, rows come from expressions over a range.

Row counts follow the benchmark's scale; values are deterministic functions of the row number, made
in parallel on the executors.  They are not the benchmark generator's own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import Catalog

SCALES = {"sf1": 1, "sf10": 10, "sf100": 100, "sf300": 300, "sf1000": 1000}
#: Rows at scale 1 (region and nation don't grow), and the region and nation names.
ROWS = {"region": 5, "nation": 25, "supplier": 10_000, "customer": 150_000, "part": 200_000, "partsupp": 800_000, "orders": 1_500_000, "lineitem": 6_001_215}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = "ALGERIA 0,ARGENTINA 1,BRAZIL 1,CANADA 1,EGYPT 4,ETHIOPIA 0,FRANCE 3,GERMANY 3,INDIA 2,INDONESIA 2,IRAN 4,IRAQ 4,JAPAN 2,JORDAN 4,KENYA 0,MOROCCO 0,MOZAMBIQUE 0,PERU 1,CHINA 2,ROMANIA 3,SAUDI ARABIA 4,VIETNAM 2,RUSSIA 3,UNITED KINGDOM 3,UNITED STATES 1"


def _pick(values: list[str], salt: int) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(pmod(xxhash64(id, {salt}), {len(values)}) as int) + 1)"


def _money(low: int, high: int, salt: int) -> str:
    return f"cast(({low * 100} + pmod(xxhash64(id, {salt}), {(high - low) * 100})) / 100 as decimal(15, 2))"


def _number(n: object, salt: int, low: int = 1) -> str:
    return f"({low} + pmod(xxhash64(id, {salt}), {n}))"


def _day(salt: int) -> str:
    return f"date_add(date '1992-01-01', cast(pmod(xxhash64(id, {salt}), 2406) as int))"


def expressions(table: str, scale: int) -> list[str]:
    suppliers, customers, parts, orders = (ROWS[t] * scale for t in ("supplier", "customer", "part", "orders"))
    return {
        "region": ["id as r_regionkey", f"element_at(array({', '.join(map(repr, REGIONS))}), cast(id as int) + 1) as r_name", "concat('region ', id) as r_comment"],
        "nation": ["id as n_nationkey", f"split_part(element_at(split('{NATIONS}', ','), cast(id as int) + 1), right(element_at(split('{NATIONS}', ','), cast(id as int) + 1), 2), 1) as n_name", f"cast(right(element_at(split('{NATIONS}', ','), cast(id as int) + 1), 1) as bigint) as n_regionkey", "concat('nation ', id) as n_comment"],
        "supplier": ["id + 1 as s_suppkey", "format_string('Supplier#%09d', id + 1) as s_name", "concat('street ', id) as s_address", f"{_number(25, 1, 0)} as s_nationkey", f"format_string('%02d-%03d-%03d-%04d', {_number(25, 1, 10)}, {_number(900, 2, 100)}, {_number(900, 3, 100)}, {_number(9000, 4, 1000)}) as s_phone", f"{_money(-999, 9999, 5)} as s_acctbal", "concat('comment ', id) as s_comment"],
        "customer": ["id + 1 as c_custkey", "format_string('Customer#%09d', id + 1) as c_name", "concat('street ', id) as c_address", f"{_number(25, 11, 0)} as c_nationkey", f"format_string('%02d-%03d-%03d-%04d', {_number(25, 11, 10)}, {_number(900, 12, 100)}, {_number(900, 13, 100)}, {_number(9000, 14, 1000)}) as c_phone", f"{_money(-999, 9999, 15)} as c_acctbal", f"{_pick(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], 16)} as c_mktsegment", "concat('comment ', id) as c_comment"],
        "part": ["id + 1 as p_partkey", f"concat_ws(' ', {_pick(['almond', 'forest', 'green', 'ivory', 'rose'], 21)}, {_pick(['azure', 'blush', 'lime', 'navy', 'peach'], 22)}) as p_name", f"concat('Manufacturer#', {_number(5, 23)}) as p_mfgr", f"concat('Brand#', {_number(5, 23)}, {_number(5, 24)}) as p_brand", f"concat_ws(' ', {_pick(['STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'PROMO'], 25)}, {_pick(['ANODIZED', 'BURNISHED', 'PLATED', 'POLISHED', 'BRUSHED'], 26)}, {_pick(['TIN', 'NICKEL', 'BRASS', 'STEEL', 'COPPER'], 27)}) as p_type", f"cast({_number(50, 28)} as int) as p_size", f"concat_ws(' ', {_pick(['SM', 'LG', 'MED', 'JUMBO', 'WRAP'], 29)}, {_pick(['CASE', 'BOX', 'BAG', 'JAR', 'PKG', 'PACK', 'CAN', 'DRUM'], 30)}) as p_container", "cast((90000 + pmod(div_ten, 20001) + 100 * pmod(id + 1, 1000)) / 100 as decimal(15, 2)) as p_retailprice".replace("div_ten", "(id + 1) div 10"), "concat('comment ', id) as p_comment"],
        "partsupp": ["id div 4 + 1 as ps_partkey", f"pmod(id div 4 + (id % 4) * ({suppliers} div 4), {suppliers}) + 1 as ps_suppkey", f"cast({_number(9999, 31)} as int) as ps_availqty", f"{_money(1, 1000, 32)} as ps_supplycost", "concat('comment ', id) as ps_comment"],
        "orders": ["(id div 8) * 32 + id % 8 + 1 as o_orderkey", f"{_number(customers, 41)} as o_custkey", f"{_pick(['O', 'F', 'P'], 42)} as o_orderstatus", f"{_money(857, 555285, 43)} as o_totalprice", f"{_day(44)} as o_orderdate", f"{_pick(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], 45)} as o_orderpriority", f"format_string('Clerk#%09d', {_number(1000 * scale, 46)}) as o_clerk", "0 as o_shippriority", "concat('comment ', id) as o_comment"],
        "lineitem": [f"(pmod(id div 4, {orders}) div 8) * 32 + pmod(id div 4, {orders}) % 8 + 1 as l_orderkey", f"{_number(parts, 51)} as l_partkey", f"{_number(suppliers, 52)} as l_suppkey", f"cast(id % 4 + 4 * (id div (4 * {orders})) + 1 as int) as l_linenumber", f"cast({_number(50, 53)} as decimal(15, 2)) as l_quantity", f"{_money(901, 104949, 54)} as l_extendedprice", f"cast({_number(11, 55, 0)} / 100 as decimal(15, 2)) as l_discount", f"cast({_number(9, 56, 0)} / 100 as decimal(15, 2)) as l_tax", f"{_pick(['R', 'A', 'N'], 57)} as l_returnflag", f"{_pick(['O', 'F'], 58)} as l_linestatus", f"{_day(59)} as l_shipdate", f"{_day(60)} as l_commitdate", f"date_add({_day(59)}, cast({_number(30, 61)} as int)) as l_receiptdate", f"{_pick(['DELIVER IN PERSON', 'COLLECT COD', 'NONE', 'TAKE BACK RETURN'], 62)} as l_shipinstruct", f"{_pick(['REG AIR', 'AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'FOB'], 63)} as l_shipmode", "concat('comment ', id) as l_comment"],
    }[table]


def row_count(table: str, scale: int) -> int:
    return ROWS[table] * (1 if table in ("region", "nation") else scale)


class TpchCatalog(Catalog):
    kind = "TPCH"

    def schemas(self) -> list[str]:
        return sorted(SCALES)

    def tables(self, schema: str) -> list[str]:
        return sorted(ROWS)

    def load(self, spark: SparkSession, schema: str, table: str) -> DataFrame:
        """Columns that a query doesn't use are not computed; region and nation are one partition."""
        self.require(schema, table)
        n = row_count(table, SCALES[schema])
        rows = spark.range(0, n, 1, 1) if n < 100 else spark.range(n)
        return rows.selectExpr(*expressions(table, SCALES[schema]))
