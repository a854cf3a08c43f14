"""Query texts.  DUCK has those whose DuckDB spelling differs."""

from __future__ import annotations

_REV = "l_extendedprice * (1 - l_discount)"


def _money(x: str, name: str) -> str:
    """Exact sums: each row is rounded to a decimal first, so the order of addition doesn't matter."""
    return f"cast(sum(cast({x} as decimal(18, 4))) as double) as {name}"


SPARK: dict[str, str] = {
    # ---------------------------------------------------------------- TPC-H shapes
    "tpch_q01": f"select l_returnflag, l_linestatus, {_money('l_quantity', 'sum_qty')}, {_money('l_extendedprice', 'sum_base_price')}, {_money(_REV, 'sum_disc_price')}, {_money(_REV + ' * (1 + l_tax)', 'sum_charge')}, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 2) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from {{lineitem}} where l_shipdate <= date '1998-12-01' - interval '90' day group by l_returnflag, l_linestatus",
    "tpch_q03": f"select l_orderkey, {_money(_REV, 'revenue')}, cast(o_orderdate as date) as o_orderdate from {{customer}}, {{orders}}, {{lineitem}} where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by l_orderkey, cast(o_orderdate as date) order by revenue desc, l_orderkey, o_orderdate limit 10",
    "tpch_q04_like": "select o_orderpriority, count(*) as order_count from {orders} where o_orderdate >= date '1997-07-01' and o_orderdate < date '1997-07-01' + interval '3' month and exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R') group by o_orderpriority",
    "tpch_q05": f"select n_name, {_money(_REV, 'revenue')} from {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}} where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 2 group by n_name",
    "tpch_q06": f"select {_money('l_extendedprice * l_discount', 'revenue')} from {{lineitem}} where l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '1' year and l_discount between 0.05 and 0.07 and l_quantity < 24",
    "tpch_q07": f"select supp_nation, cust_nation, l_year, {_money('volume', 'revenue')} from (select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, {_REV} as volume from {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1'))) shipping group by supp_nation, cust_nation, l_year",
    "tpch_q08": f"select o_year, round(cast(sum(cast(case when nation = 'NATION_3' then volume else 0 end as decimal(18, 4))) as double) / cast(sum(cast(volume as decimal(18, 4))) as double), 8) as mkt_share from (select cast(extract(year from o_orderdate) as int) as o_year, {_REV} as volume, n2.n_name as nation from {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}} where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_regionkey = 1 and s_nationkey = n2.n_nationkey and p_type = 'ECONOMY') all_nations group by o_year",
    "tpch_q10": f"select c_custkey, c_name, {_money(_REV, 'revenue')}, c_acctbal, n_name from {{customer}}, {{orders}}, {{lineitem}}, {{nation}} where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1997-10-01' and o_orderdate < date '1997-10-01' + interval '3' month and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20",
    "tpch_q11_like": f"select l_suppkey, {_money('l_extendedprice', 'value')} from {{lineitem}} group by l_suppkey having sum(cast(l_extendedprice as decimal(18, 4))) > (select sum(cast(l_extendedprice as decimal(18, 4))) * 0.011 from {{lineitem}})",
    "tpch_q12_like": "select l_linestatus, cast(sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as high_line_count, cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count from {orders}, {lineitem} where o_orderkey = l_orderkey and l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01' group by l_linestatus",
    "tpch_q13_like": "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from {customer} left outer join {orders} on c_custkey = o_custkey and o_orderstatus <> 'P' group by c_custkey) c_orders group by c_count",
    "tpch_q14": f"select round(100.0 * cast(sum(cast(case when p_type like 'PROMO%' then {_REV} else 0 end as decimal(18, 4))) as double) / cast(sum(cast({_REV} as decimal(18, 4))) as double), 6) as promo_revenue from {{lineitem}}, {{part}} where l_partkey = p_partkey and l_shipdate >= date '1997-09-01' and l_shipdate < date '1997-09-01' + interval '1' month",
    "tpch_q15_like": f"with revenue0 as (select l_suppkey as supplier_no, sum(cast({_REV} as decimal(18, 4))) as total_revenue from {{lineitem}} where l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '3' month group by l_suppkey) select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from {{supplier}}, revenue0 where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue0)",
    "tpch_q16_like": "select p_brand, p_type, count(distinct l_suppkey) as supplier_cnt from {lineitem}, {part} where p_partkey = l_partkey and p_brand <> 'Brand#5' and p_size in (9, 14, 19, 23, 36, 45, 49, 3) and l_suppkey not in (select s_suppkey from {supplier} where s_acctbal < 0) group by p_brand, p_type",
    "tpch_q17_like": f"select cast(sum(cast(l_extendedprice as decimal(18, 4))) as double) / 7.0 as avg_yearly from {{lineitem}}, {{part}} where p_partkey = l_partkey and p_brand = 'Brand#3' and l_quantity < (select 0.5 * avg(l_quantity) from {{lineitem}} l2 where l2.l_partkey = p_partkey)",
    "tpch_q18": f"select c_name, c_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice, {_money('l_quantity', 'sum_qty')} from {{customer}}, {{orders}}, {{lineitem}} where o_orderkey in (select l_orderkey from {{lineitem}} group by l_orderkey having sum(l_quantity) > 200) and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, cast(o_orderdate as date), o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100",
    "tpch_q19_like": f"select {_money(_REV, 'revenue')} from {{lineitem}}, {{part}} where (p_partkey = l_partkey and p_brand = 'Brand#1' and l_quantity >= 1 and l_quantity <= 11 and p_size between 1 and 15) or (p_partkey = l_partkey and p_brand = 'Brand#2' and l_quantity >= 10 and l_quantity <= 20 and p_size between 1 and 25) or (p_partkey = l_partkey and p_brand = 'Brand#3' and l_quantity >= 20 and l_quantity <= 30 and p_size between 1 and 35)",
    "tpch_q20_like": "select s_suppkey, s_name from {supplier} where s_suppkey in (select l_suppkey from {lineitem} where l_partkey in (select p_partkey from {part} where p_name like 's%') and l_quantity > (select 0.9 * max(l2.l_quantity) from {lineitem} l2 where l2.l_suppkey = {lineitem}.l_suppkey))".replace("from {lineitem} where l_partkey", "from {lineitem} l1 where l_partkey").replace("{lineitem}.l_suppkey", "l1.l_suppkey"),
    "tpch_q21_like": "select s_name, count(*) as numwait from {supplier}, {lineitem} l1, {orders} where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R' and exists (select 1 from {lineitem} l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from {lineitem} l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R') group by s_name",
    "tpch_q22_like": "select cntrycode, count(*) as numcust, cast(sum(cast(c_acctbal as decimal(18, 4))) as double) as totacctbal from (select substring(c_name, 10, 2) as cntrycode, c_acctbal from {customer} where c_acctbal > (select avg(c_acctbal) from {customer} where c_acctbal > 0.00) and not exists (select 1 from {orders} where o_custkey = c_custkey)) custsale group by cntrycode",
    # ---------------------------------------------------------------- projections and predicates
    "project_alias_arith": "select o_orderkey, o_totalprice * 2 + 1 as twice, o_custkey % 7 as bucket, -o_custkey as negative from {orders}",
    "pred_compare": "select p_partkey from {part} where p_size > 10 and 40 >= p_size and p_size <> 20 and p_retailprice < 1500",
    "pred_between": "select p_partkey, p_size from {part} where p_size between 5 and 9 and p_size not between 7 and 8",
    "pred_in_null": "select p_partkey from {part} where p_size in (1, 2, null) ",
    "pred_not_in_null": "select p_partkey from {part} where p_size not in (1, 2, null)",
    "pred_is_null": "select count(*) as n, count(x) as n_x from (select nullif(p_size, 10) as x from {part}) t where x is null or x > 45",
    "pred_eq_null": "select p_partkey from {part} where p_size = null",
    "pred_three_valued": "select a is null as a_null, b, count(*) as n from (select nullif(p_size % 3, 0) > 1 as a, p_size > 25 as b from {part}) t where not (a and b) or (a or b) is null group by 1, 2",
    "pred_like": "select count_if(p_name like '%ring') as a, count_if(p_name not like 's%') as b, count_if(p_name like '_m%') as c from {part}",
    "case_forms": "select case o_orderstatus when 'O' then 'open' when 'F' then 'final' else 'other' end as simple, case when o_totalprice > 100000 then 'big' when o_totalprice > 10000 then 'mid' else 'small' end as searched, count(*) as n from {orders} group by 1, 2",
    "cast_try": "select p_partkey, try_cast(p_brand as int) as bad, try_cast(cast(p_size as varchar(10)) as int) as good, cast(p_retailprice as decimal(12, 2)) as d from {part}",
    "date_interval": "select o_orderkey, cast(o_orderdate + interval '1' month as date) as m, cast(o_orderdate - interval '3' day as date) as d, cast(extract(month from o_orderdate) as int) as mon from {orders} where o_orderdate >= timestamp '1997-01-31 00:00:00'",
    "subquery_cte": "with big as (select o_custkey, count(*) as n from {orders} group by o_custkey), top as (select max(n) as m from big) select o_custkey, n from big, top where n >= m - 2",
    "values_rows": "select * from (values (1, 'a'), (2, 'b'), (3, null)) as t(id, name)",
    "limit_zero": "select o_orderkey from {orders} limit 0",
    # ---------------------------------------------------------------- joins
    "join_inner": "select o_orderkey, c_name from {orders} join {customer} on o_custkey = c_custkey where o_totalprice > 100000",
    "join_left": "select c_custkey, o_orderkey from {customer} left join {orders} on c_custkey = o_custkey and o_orderstatus = 'P'",
    "join_right": "select c_custkey, o_orderkey from {orders} right join {customer} on c_custkey = o_custkey and o_totalprice > 150000",
    "join_full": "select c_custkey, s_suppkey from {customer} full outer join {supplier} on c_custkey = s_suppkey * 10",
    "join_cross": "select r_name, n_name from {region} cross join {nation}",
    "join_semi": "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'P')",
    "join_semi_in": "select c_custkey from {customer} where c_custkey in (select o_custkey from {orders} where o_totalprice > 100000)",
    "join_anti": "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_totalprice > c_acctbal * 5)",
    "join_null_aware_anti": "select c_custkey from {customer} where c_custkey not in (select nullif(o_custkey, 7) from {orders} where o_custkey <> 7)",
    "join_theta": "select n.n_nationkey, count(*) as n from {nation} n join {region} r on n.n_regionkey < r.r_regionkey group by n.n_nationkey",
    "join_self": "select a.n_name as x, b.n_name as y from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_lateral": "select c.c_custkey, t.o_totalprice from {customer} c join lateral (select max(o_totalprice) as o_totalprice from {orders} o where o.o_custkey = c.c_custkey) t on true",
    "scalar_subquery": "select n_name, (select count(*) from {customer} where c_nationkey = n_nationkey) as customers from {nation}",
    "unnest_array": "select vec_id, cast(x as double) as x from (select vec_id, explode(embedding) as x from {embeddings}) t where x > 0.4",
    # ---------------------------------------------------------------- aggregates
    "agg_basic": "select event_type, count(*) as n, round(sum(cast(value as decimal(28, 6))), 4) as s, min(value) as lo, max(value) as hi from {events} group by event_type",
    "agg_distinct": "select event_type, count(distinct user_id) as users, count(user_id) as rows_ from {events} group by event_type",
    "agg_filter": "select event_type, count(*) filter (where value > 50) as big, cast(sum(user_id) filter (where value <= 50) as bigint) as s from {events} group by event_type",
    "agg_rollup": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
    "agg_cube": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by cube (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "select l_returnflag, l_linenumber, count(*) as n, cast(grouping(l_returnflag) as int) as g from {lineitem} group by grouping sets ((l_returnflag), (l_linenumber), ())",
    "agg_stats": "select round(stddev_samp(p_size), 8) as sd, round(stddev_pop(p_size), 8) as sdp, round(var_samp(p_size), 8) as v, round(var_pop(p_size), 8) as vp, round(corr(p_size, p_retailprice), 8) as c, round(covar_pop(p_size, p_retailprice), 6) as cp, round(covar_samp(p_size, p_retailprice), 6) as cs, median(p_size) as med, round(regr_slope(p_retailprice, p_size), 8) as sl from {part}",
    "agg_bool_bit": "select p_brand, bool_and(p_size > 0) as ba, bool_or(p_size > 49) as bo, bit_and(p_size) as a, bit_or(p_size) as o, bit_xor(p_size) as x from {part} group by p_brand",
    "agg_string": "select n_regionkey, string_agg(n_name, ',') within group (order by n_name) as names from {nation} group by n_regionkey",
    "agg_array": "select n_regionkey, cardinality(collect_list(n_name)) as n, array_join(array_sort(collect_list(n_name)), ';') as names from {nation} group by n_regionkey",
    "agg_percentile": "select percentile_cont(0.25) within group (order by p_size) as q1, percentile_cont(0.75) within group (order by p_size) as q3 from {part}",
    "agg_empty": "select count(*) as n, sum(p_size) is null as s, max(p_size) is null as m from {part} where p_size < 0",
    "agg_having": "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 15",
    "agg_nested": "select n, count(*) as customers from (select o_custkey, count(*) as n from {orders} group by o_custkey) t group by n",
    "distinct_rows": "select distinct o_orderstatus, o_orderpriority from {orders}",
    # ---------------------------------------------------------------- windows
    "win_rank_family": "select p_partkey, row_number() over w as rn, rank() over w2 as rk, dense_rank() over w2 as dr, round(percent_rank() over w2, 8) as pr, round(cume_dist() over w2, 8) as cd, ntile(4) over w as nt from {part} window w as (partition by p_brand order by p_size, p_partkey), w2 as (partition by p_brand order by p_size)",
    "win_lag_lead": "select event_id, lag(value) over w as prev, lead(value, 2) over w as next2, lag(value, 1, -1) over w as dflt from {events} window w as (partition by user_id order by ts, event_id)",
    "win_nth": "select event_id, first_value(value) over w as f, last_value(value) over w as l, nth_value(value, 2) over w as n from {events} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)",
    "win_rows_frame": "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18, 4))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as double) as s from {orders}",
    "win_range_frame": "select p_partkey, count(*) over (partition by p_brand order by p_size range between 3 preceding and 3 following) as n from {part}",
    "win_groups_frame": "select p_partkey, count(*) over (partition by p_brand order by g range between 1 preceding and current row) as n from (select p_partkey, p_brand, dense_rank() over (partition by p_brand order by p_size) as g from {part}) t",
    "win_agg": "select c_custkey, max(c_acctbal) over (partition by c_nationkey) as top, count(*) over (partition by c_nationkey) as n from {customer}",
    "win_qualify": "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from {part}) t where rn <= 2",
    # ---------------------------------------------------------------- order, limit, sets
    "sort_nulls_last": "select row_number() over (order by x asc nulls last, p_partkey) as pos, x, p_partkey from (select nullif(p_size, 1) as x, p_partkey from {part}) t",
    "topk": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25",
    "limit_offset": "select p_partkey from {part} order by p_retailprice, p_partkey limit 10 offset 20",
    "set_union": "select n_regionkey as k from {nation} union select r_regionkey from {region}",
    "set_union_all": "select c_nationkey as k from {customer} union all select s_nationkey from {supplier}",
    "set_intersect": "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}",
    "set_except": "select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_acctbal > 5000",
    "set_intersect_all": "select c_nationkey as k from {customer} intersect all select s_nationkey from {supplier}",
    "set_except_all": "select c_nationkey as k from {customer} except all select s_nationkey from {supplier}",
    "recursive_cte": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",
    # ---------------------------------------------------------------- functions
    "fn_string": "select p_partkey, length(p_name) as len, upper(p_name) as up, lower(p_brand) as lo, substring(p_name, 2, 3) as sub, concat(p_brand, '-', p_type) as cc, concat_ws('|', p_brand, p_type) as cw, replace(p_name, 'ring', 'RING') as rp, reverse(p_name) as rv, lpad(p_type, 10, '*') as lp, rpad(p_type, 10, '*') as rpd, trim('  x ') as tr, left(p_name, 3) as lf, right(p_name, 3) as rg, split_part(p_name, ' ', 1) as sp, repeat('ab', 2) as re, ascii(p_name) as asc_, translate(p_name, 'aei', 'xyz') as tl, levenshtein(p_name, p_type) as lv, starts_with(p_name, 's') as sw, contains(p_name, 'in') as ct from {part}".replace("starts_with(", "startswith("),
    "fn_regex": "select p_partkey, regexp_like(p_name, '^[a-m]') as rl, regexp_replace(p_name, '[aeiou]', '_', 'g') as rr, regexp_extract(p_brand, '([0-9]+)', 1) as ex from {part}".replace(", 'g'", ""),
    "fn_math": "select p_partkey, abs(-p_size) as a, ceil(p_retailprice) as c, floor(p_retailprice) as f, round(sqrt(p_size), 8) as s, round(ln(p_size), 8) as l, round(exp(1.0 / p_size), 8) as e, round(power(p_size, 2), 4) as p, sign(p_size - 25) as sg, round(sin(p_size), 8) as sn, round(atan2(p_size, 2), 8) as at, p_size % 7 as md, greatest(p_size, 25) as g, least(p_size, 25) as le, round(degrees(1.0), 8) as dg, round(cbrt(p_size), 8) as cb, round(log10(p_size), 8) as lt from {part}",
    "fn_date": "select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d, cast(quarter(o_orderdate) as int) as q, cast(date_trunc('month', o_orderdate) as date) as t, cast(last_day(o_orderdate) as date) as ld, make_date(1997, 2, 3) as md from {orders}",
    "fn_cond": "select p_partkey, coalesce(nullif(p_size, 1), -1) as c, nullif(p_size, 2) as n, ifnull(nullif(p_size, 3), 0) as i, if(p_size > 9, 'x', 'y') as f from {part}",
    "fn_hash": "select p_partkey, md5(p_name) as m, sha2(p_name, 256) as s, lower(hex(p_brand)) as h, base64(cast(p_brand as binary)) as b from {part}",
    "fn_json": "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events}",
    "fn_array": "select n_nationkey, cardinality(array(n_nationkey, n_regionkey)) as c, array_contains(array(n_nationkey, 3), 3) as h, array_join(array('a', n_name), '-') as j, array_max(array(n_nationkey, n_regionkey)) as mx, element_at(array(n_nationkey, n_regionkey), 2) as e2, try_element_at(array(n_nationkey), 5) as oob, array_position(array(5, n_regionkey), 5) as p, cardinality(array_distinct(array(1, 1, n_regionkey))) as d, cardinality(sequence(1, 5)) as sq from {nation}",
    "fn_map": "select n_nationkey, element_at(map('k', n_name), 'k') as v, cardinality(map('a', 1, 'b', 2)) as c, array_join(map_keys(map('a', 1, 'b', 2)), ',') as ks from {nation}",
    "fn_struct": "select n_nationkey, s.a as a, s.b as b from (select n_nationkey, named_struct('a', n_name, 'b', n_regionkey) as s from {nation}) t",
    "fn_lambda": "select vec_id, cardinality(filter(embedding, x -> x > 0)) as pos, round(aggregate(embedding, cast(0 as double), (a, x) -> a + cast(round(x, 4) as double)), 3) as s from {embeddings}",
}

DUCK: dict[str, str] = {
    "agg_string": "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from {nation} group by n_regionkey",
    "unnest_array": "select vec_id, cast(x as double) as x from (select vec_id, unnest(embedding) as x from {embeddings}) t where x > 0.4",
    "agg_array": "select n_regionkey, len(list(n_name)) as n, array_to_string(list_sort(list(n_name)), ';') as names from {nation} group by n_regionkey",
    "fn_regex": "select p_partkey, regexp_matches(p_name, '^[a-m]') as rl, regexp_replace(p_name, '[aeiou]', '_', 'g') as rr, regexp_extract(p_brand, '([0-9]+)', 1) as ex from {part}",
    "fn_string": SPARK["fn_string"].replace("startswith(", "starts_with("),
    "fn_hash": "select p_partkey, md5(p_name) as m, sha256(p_name) as s, lower(hex(p_brand)) as h, base64(encode(p_brand)) as b from {part}",
    "fn_json": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from {events}",
    "fn_array": "select n_nationkey, 2 as c, list_contains([n_nationkey, 3], 3) as h, array_to_string(['a', n_name], '-') as j, greatest(n_nationkey, n_regionkey) as mx, n_regionkey as e2, cast(null as int) as oob, cast(1 as bigint) as p, len(list_distinct([1, 1, n_regionkey])) as d, 5 as sq from {nation}",
    "fn_map": "select n_nationkey, n_name as v, 2 as c, 'a,b' as ks from {nation}",
    "fn_struct": "select n_nationkey, s.a as a, s.b as b from (select n_nationkey, {'a': n_name, 'b': n_regionkey} as s from {nation}) t",
    "fn_lambda": "select vec_id, len(list_filter(embedding, lambda x: x > 0)) as pos, round(list_sum(list_transform(embedding, lambda x: cast(round(x, 4) as double))), 3) as s from {embeddings}",
}
