"""Plain SQL capabilities: one statement for both engines, tables in braces."""

from __future__ import annotations

import re

BOTH = {
    "sql_group_having": "select o_orderpriority, count(*) as n, round(avg(o_totalprice), 2) as mean from {orders} group by o_orderpriority having count(*) > 10",
    "sql_cte_subquery": """with top as (select o_custkey, sum(o_totalprice) as total from {orders} group by o_custkey) select c_custkey, round(total, 2) as total from top join {customer} on c_custkey = o_custkey
        where total > (select avg(total) from top)""",
    "sql_correlated": "select s_suppkey, s_acctbal from {supplier} s where s_acctbal >= (select avg(x.s_acctbal) from {supplier} x where x.s_nationkey = s.s_nationkey)",
    "sql_case_cast": "select case when p_size < 15 then 'small' when p_size between 15 and 30 then 'middle' else 'large' end as band, cast(count(*) as bigint) as n, round(avg(coalesce(p_retailprice, 0)), 4) as mean from {part} group by 1",
    "sql_like_in": "select p_partkey, p_name from {part} where (lower(p_name) like '%a%' or p_type in ('PROMO', 'ECONOMY')) and p_brand is not null",
    "unique_counts": "select count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, count(distinct l_shipdate) as days from {lineitem}",
    "join_inner": "select c_custkey, n_name, r_name from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey",
    "join_left": "select c_custkey, o_orderkey from {customer} left join {orders} on c_custkey = o_custkey and o_totalprice > 300000",
    "join_full": "select s_suppkey, c_custkey from {supplier} full join {customer} on s_suppkey = c_custkey",
    "join_right": "select n_nationkey, s_suppkey from {supplier} right join {nation} on s_nationkey = n_nationkey and s_acctbal > 5000",
    "join_semi": "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'F')",
    "join_anti": "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey)",
    "join_theta": "select a.n_nationkey as a, b.n_nationkey as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_theta_only": "select r_regionkey, n_nationkey from {region} join {nation} on r_regionkey < n_regionkey",
    "join_cross": "select r_regionkey, n_nationkey from {region} cross join {nation}",
    "union_all": "select c_nationkey as k from {customer} union all select s_nationkey from {supplier}",
    "union_distinct": "select c_nationkey as k from {customer} union select s_nationkey from {supplier}",
    "intersect": "select c_custkey as k from {customer} intersect select s_suppkey from {supplier}",
    "except": "select c_custkey as k from {customer} except select s_suppkey from {supplier}",
    "rank_family": """select c_custkey, cast(row_number() over w as bigint) as rn, cast(rank() over w as bigint) as rk, cast(dense_rank() over w as bigint) as dr, cast(ntile(4) over w as bigint) as nt, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd
        from {customer} window w as (partition by c_nationkey order by c_acctbal, c_custkey)""",
    "lag_lead": "select event_id, lag(value, 1) over w as before, lead(value, 2) over w as after, first_value(value) over w as first from {events} window w as (partition by user_id order by event_id)",
    "nth_last_range": """select event_id, nth_value(value, 2) over w as second, last_value(value) over w as last, count(*) over (partition by user_id order by event_id range between 100 preceding and current row) as near
        from {events} window w as (partition by user_id order by event_id rows between unbounded preceding and unbounded following)""",
    "running_sum": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as total from {orders}",
    "sort_limit": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc nulls last, o_orderkey limit 20 offset 5",
    "rollup": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
    "cube": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by cube (l_returnflag, l_linestatus)",
    "grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "date_trunc_agg": "select date_trunc('month', o_orderdate) as month, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} group by 1",
    "string_fns": "select p_partkey, upper(p_name) as up, substring(p_name, 1, 3) as head, length(p_name) as len, replace(p_brand, '#', '-') as brand, trim(concat(' ', p_type, ' ')) as kind from {part}",
    "group_revenue": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from {lineitem}
        where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2""",
    "join_big": """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey group by n_name""",
}
APART = {
    "json_props": ("select event_id, length(props) as len, get_json_object(props, '$.k') as k from {events}", "select event_id, length(props) as len, json_extract_string(props, '$.k') as k from events"),
    "group_concat": ("select n_regionkey, array_join(sort_array(collect_list(n_name)), ',') as names from {nation} group by 1", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1"),
    "approximate_aggregates": ("select l_returnflag, approx_count_distinct(l_quantity, 0.01) as quantities, approx_percentile(l_quantity, 0.5, 10000) as middle, approx_percentile(l_quantity, 0.9, 10000) as high from {lineitem} group by 1",
        "select l_returnflag, count(distinct l_quantity) as quantities, quantile_disc(l_quantity, 0.5) as middle, quantile_disc(l_quantity, 0.9) as high from lineitem group by 1"),
    "integer_division": ("select c_custkey, c_custkey div 7 as d, try_divide(c_custkey, c_nationkey) is null as undefined from {customer}", "select c_custkey, c_custkey // 7 as d, c_nationkey = 0 as undefined from customer"),
}
TABULAR = {k: (v, re.sub(r"\{(\w+)\}", r"\1", v)) for k, v in BOTH.items()} | APART
