"""A query for each verb and its options over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, settings
from .functions import expressions as e
from .functions import scalars as s
from .functions.selectors import all_of, any_of, contains, ends_with, everything, is_numeric, last_col, matches, nothing, num_range, starts_with, where
from .operators.frame import Tidy, bind_cols, bind_rows, desc, tidy
from .sources import tables
from .streaming import windowed

#: lineitem has no key: all columns order it.
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], Tidy]], object]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(lambda t: tidy(spark.read.parquet(f"{sf_dir}/{t}.parquet")))).df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(x: object, digits: int = 4):
    """Rounded, as sums of doubles differ in their last bits."""
    return x.pipe(lambda c: F.round(c.cast("double"), digits)) if isinstance(x, e.Expr) else F.round(x, digits)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 4) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by all")
def summarise_pricing(t):
    return t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date")).summarise(
        sum_qty=_r(e.sum("l_quantity"), 2), sum_price=_r(e.sum("l_extendedprice"), 2), sum_disc=_r(e.sum(e.col("l_extendedprice") * (1 - e.col("l_discount"))), 2), avg_qty=_r(e.mean("l_quantity")), avg_disc=_r(e.mean("l_discount")), n=e.n(), by=["l_returnflag", "l_linestatus"]
    )


@query("select l_suppkey, round(stddev_samp(l_quantity), 4) as sd, round(var_samp(l_quantity), 4) as var, median(l_quantity) as med, count(distinct l_partkey) as parts, min(l_tax) as lo, max(l_tax) as hi from lineitem group by l_suppkey")
def summarise_stats(t):
    return t("lineitem").summarise(sd=_r(e.sd("l_quantity")), var=_r(e.var("l_quantity")), med=e.median("l_quantity"), parts=e.n_distinct("l_partkey"), lo=e.min("l_tax"), hi=e.max("l_tax"), by="l_suppkey")


@query("select l_orderkey, l_partkey, round(product(1 + l_tax), 6) as p from lineitem group by all")
def summarise_prod(t):
    return t("lineitem").summarise(p=_r(e.prod(1 + e.col("l_tax")), 6), by=["l_orderkey", "l_partkey"])


@query("select user_id, arg_min(event_type, event_id) as first_type, arg_max(value, event_id) as last_value from events group by user_id")
def summarise_first_last(t):
    return t("events").summarise(first_type=e.first("event_type"), last_value=e.last("value"), by="user_id", order_by="event_id")


@query("select nullif(l_returnflag, 'N') as flag, count(*) as n, round(sum(l_tax), 4) as tax from lineitem group by all")
def summarise_na_group(t):
    return t("lineitem").mutate(flag=F.nullif(F.col("l_returnflag"), F.lit("N"))).summarise(n=e.n(), tax=_r(e.sum("l_tax")), by="flag")


@query("select l_returnflag, case when count(*) = count(nullif(l_linenumber, 1)) then avg(nullif(l_linenumber, 1)) end as strict, round(avg(nullif(l_linenumber, 1)), 4) as lenient from lineitem group by all")
def summarise_na_rm(t):
    x = F.nullif(F.col("l_linenumber"), F.lit(1))
    return t("lineitem").summarise(strict=e.mean(x, na_rm=False), lenient=_r(e.mean(x)), by="l_returnflag")


@query("select l_returnflag, round(avg(l_quantity), 4) as l_quantity_mean, max(l_quantity) as l_quantity_max, round(avg(l_tax), 4) as l_tax_mean, max(l_tax) as l_tax_max from lineitem group by 1")
def across_multi(t):
    return t("lineitem").summarise(e.across(["l_quantity", "l_tax"], {"mean": lambda c: _r(e.mean(c)), "max": e.max}), by="l_returnflag")


@query("select l_linestatus, round(avg(l_quantity), 4) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice, round(avg(l_discount), 4) as l_discount, round(avg(l_tax), 4) as l_tax from lineitem group by 1")
def across_where(t):
    return t("lineitem").select("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax").summarise(e.across(where(is_numeric), lambda c: _r(e.mean(c))), by="l_linestatus")


@query("select event_id, round(avg(value) over (partition by user_id), 4) as m, round(value / sum(value) over (partition by user_id), 6) as share, count(*) over (partition by user_id) as n, max(value) over (partition by user_id) as hi from events")
def mutate_grouped(t):
    return t("events").mutate(m=_r(e.mean("value")), share=_r(e.col("value") / e.sum("value"), 6), n=e.n(), hi=e.max("value"), by="user_id").select("event_id", "m", "share", "n", "hi")


@query("select event_id, row_number() over w as rn, lag(value) over w as prev, lead(value, 2, -1.0) over w as next2, first_value(event_type) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as first_type from events window w as (partition by user_id order by event_id)")
def mutate_ordered(t):
    return t("events").mutate(rn=e.row_number(), prev=e.lag("value"), next2=e.lead("value", 2, -1.0), first_type=e.first("event_type"), by="user_id", order_by="event_id").select("event_id", "rn", "prev", "next2", "first_type")


@query("select o_orderkey, (o_orderkey % 7 - 3) as a, ((o_orderkey % 7 - 3) - floor((o_orderkey % 7 - 3) / 3.0) * 3)::bigint as m, floor((o_orderkey % 7 - 3) / 3.0)::bigint as q, round_even(o_totalprice, 0) as r, case when o_orderkey % 7 = 3 then null else (o_orderkey % 7 - 3) / 2.0 end as d from orders")
def mutate_scalars(t):
    return t("orders").mutate(a=F.col("o_orderkey") % 7 - 3).mutate(m=s.mod(F.col("a"), F.lit(3)), q=s.idiv(F.col("a"), F.lit(3)), r=s.round(F.col("o_totalprice"), 0), d=F.nullif(s.div(F.col("a"), F.lit(2)), F.lit(0.0))).select("o_orderkey", "a", "m", "q", "r", "d")



@query("select c_acctbal, c_acctbal + 1 as z from customer")
def keep_used_only(t):
    return t("customer").mutate(z=F.col("c_acctbal") + 1, keep="used")


@query("select c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal + 1 as z from customer")
def keep_unused(t):
    return t("customer").mutate(z=F.col("c_acctbal") + 1, keep="unused")


@query("select c_nationkey, round(avg(c_acctbal) over (partition by c_nationkey), 4) as z from customer")
def keep_none(t):
    return t("customer").group_by("c_nationkey").mutate(z=_r(e.mean("c_acctbal")), keep="none")


@query("select c_custkey, c_name as name, c_acctbal as bal from customer")
def select_rename(t):
    return t("customer").select("c_custkey", name="c_name", bal="c_acctbal")


@query("select l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, l_linestatus from lineitem")
def select_helpers(t):
    return t("lineitem").select(ends_with("key"), "l_extendedprice:l_discount", contains("flag") | starts_with("l_lines"))


@query("select * exclude (l_shipdate, l_tax) from lineitem")
def select_without(t):
    return t("lineitem").select("-l_shipdate", "-l_tax")


@query("select * from lineitem where l_quantity > 45 and l_discount <= 0.02")
def filter_multi(t):
    return t("lineitem").filter(F.col("l_quantity") > 45, F.col("l_discount") <= 0.02)


@query("select * from events qualify value > 1.5 * avg(value) over (partition by user_id)")
def filter_grouped(t):
    return t("events").filter(e.col("value") > 1.5 * e.mean("value"), by="user_id", order_by="event_id")


@query("select event_id, nullif(event_type, 'click') as kind, case when value > 50 then value end as big from events where nullif(event_type, 'click') is not null and value > 50")
def drop_any_na(t):
    return _holes(t).remove_rows_if_any_na("kind", "big")


@query("select event_id, nullif(event_type, 'click') as kind, case when value > 50 then value end as big from events where nullif(event_type, 'click') is not null or value > 50")
def drop_all_na(t):
    return _holes(t).remove_rows_if_all_na("kind", "big")


def _holes(t):
    return t("events").mutate(kind=F.nullif(F.col("event_type"), F.lit("click")), big=F.when(F.col("value") > 50, F.col("value"))).select("event_id", "kind", "big")


_GAPS = "select event_id, user_id, case when event_id % 3 = 0 then value end as v from events"


def _gaps(t):
    return t("events").mutate(v=F.when(F.col("event_id") % 3 == 0, F.col("value"))).select("event_id", "user_id", "v")


@query(f"select event_id, user_id, last_value(v ignore nulls) over (partition by user_id order by event_id) as v from ({_GAPS})")
def fill_forward(t):
    return _gaps(t).fill("v", by="user_id", order_by="event_id")


@query(f"select event_id, user_id, last_value(v ignore nulls) over (partition by user_id order by event_id desc) as v from ({_GAPS})")
def fill_backward(t):
    return _gaps(t).fill("v", by="user_id", direction="backwards", order_by="event_id")


@query(f"select event_id, user_id, coalesce(v, lag(v, 1) over w) as v from ({_GAPS}) window w as (partition by user_id order by event_id)")
def fill_limit(t):
    return _gaps(t).fill("v", by="user_id", limit=1, order_by="event_id")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def count(t):
    return t("lineitem").count("l_returnflag", "l_linestatus")


@query("select l_returnflag, round(sum(l_quantity), 2) as n from lineitem group by all")
def count_wt(t):
    return t("lineitem").count("l_returnflag", wt="l_quantity").mutate(n=F.round("n", 2))


@query("select *, row_number() over (order by n desc, l_suppkey) as row_id from (select l_suppkey, count(*) as n from lineitem group by all)")
def count_sort_all(t):
    return t("lineitem").count("l_suppkey", sort=True).add_row_id()


@query("select n, count(*) as nn from (select l_linenumber as n from lineitem) group by n")
def count_name_clash(t):
    return t("lineitem").select(n="l_linenumber").count("n")


@query("select count(*) as n from orders")
def count_all(t):
    return t("orders").count()


@query("select o_orderkey, count(*) over (partition by o_custkey) as n from orders")
def add_count(t):
    return t("orders").add_count("o_custkey").select("o_orderkey", "n")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct(t):
    return t("lineitem").distinct("l_returnflag", "l_linestatus")


@query("select * from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def distinct_keep_all(t):
    return t("events").distinct("user_id", "event_type", keep_all=True, order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id, event_type order by event_id) > 1")
def duplicates(t):
    return t("events").duplicates("user_id", "event_type", keep_all=True, order_by="event_id")


@query("select * from orders qualify count(*) over (partition by o_custkey, o_orderpriority) > 1")
def duplicates_both_ways(t):
    return t("orders").duplicates("o_custkey", "o_orderpriority", keep_all=True, both_ways=True)


@query("select o_orderkey, o_custkey, count(*) over (partition by o_custkey) as n from orders qualify n > 1")
def duplicates_count(t):
    return t("orders").duplicates("o_custkey", keep_all=True, both_ways=True, add_count=True).select("o_orderkey", "o_custkey", "n")


@query("select *, row_number() over (order by b desc nulls last, c_custkey) as row_id from (select *, case when c_acctbal > 0 then c_acctbal end as b from customer)")
def arrange_desc_nulls_all(t):
    return t("customer").mutate(b=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).arrange(desc("b"), "c_custkey").add_row_id()


@query("select *, row_number() over (order by c_nationkey, c_name) as row_id from customer")
def arrange_by_group_all(t):
    return t("customer").group_by("c_nationkey").arrange("c_name", by_group=True).ungroup().add_row_id()


@query("select * from events qualify row_number() over (partition by user_id order by event_id) in (2, 5)")
def slice_pos(t):
    return t("events").slice(5, 0, 2, 100000, by="user_id", order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id order by event_id) not in (1, 3)")
def slice_neg(t):
    return t("events").slice(-1, -3, by="user_id", order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id order by event_id) <= 3")
def slice_head(t):
    return t("events").slice_head(3, by="user_id", order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id order by event_id desc) <= 3")
def slice_tail(t):
    return t("events").slice_tail(3, by="user_id", order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id order by event_id) <= floor(0.25 * count(*) over (partition by user_id))")
def slice_prop(t):
    return t("events").slice_head(prop=0.25, by="user_id", order_by="event_id")


@query("select * from events qualify row_number() over (partition by user_id order by event_id) <= count(*) over (partition by user_id) - 5")
def slice_head_neg(t):
    return t("events").slice_head(-5, by="user_id", order_by="event_id")


@query("select * from lineitem qualify rank() over (partition by l_suppkey order by l_quantity) <= 2")
def slice_min(t):
    return t("lineitem").slice_min("l_quantity", 2, by="l_suppkey")


@query("select * from lineitem qualify rank() over (partition by l_suppkey order by l_quantity desc) <= 2")
def slice_max(t):
    return t("lineitem").slice_max("l_quantity", 2, by="l_suppkey")


@query("select * from events qualify row_number() over (partition by user_id order by value desc nulls last, event_id) <= 2")
def slice_max_noties(t):
    return t("events").slice_max("value", 2, by="user_id", with_ties=False, order_by="event_id")


@query()
def slice_sample(t):
    return t("events").slice_sample(5, by="user_id", seed=1)


@query()
def slice_sample_replace(t):
    return t("events").slice_sample(5, by="user_id", replace=True, seed=1)


@query()
def slice_sample_weights(t):
    return t("events").slice_sample(5, by="user_id", weights="value", seed=1)


#: Both whole tables; customers' keys are doubled, so that rows of either side lack a partner.
_JOIN = "select o_orderkey, o_custkey, c_custkey, c_name from orders o {} (select * replace (2 * c_custkey as c_custkey) from customer) c on o_custkey = c_custkey"


def _sides(t):
    return t("orders").select("o_orderkey", "o_custkey"), t("customer").mutate(c_custkey=2 * F.col("c_custkey")).select("c_custkey", "c_name")


def _joined(kind: str) -> str:
    return f"select o_orderkey, coalesce(o_custkey, c_custkey) as o_custkey, c_name from ({_JOIN.format(kind)})"


@query(_joined("left join"))
def join_left(t):
    x, y = _sides(t)
    return x.left_join(y, by={"o_custkey": "c_custkey"})


@query(_joined("right join"))
def join_right(t):
    x, y = _sides(t)
    return x.right_join(y, by={"o_custkey": "c_custkey"})


@query(_joined("join"))
def join_inner(t):
    x, y = _sides(t)
    return x.inner_join(y, by={"o_custkey": "c_custkey"})


@query(_joined("full join"))
def join_full(t):
    x, y = _sides(t)
    return x.full_join(y, by={"o_custkey": "c_custkey"})


@query("select o_orderkey, o_custkey from orders where o_custkey in (select 2 * c_custkey from customer)")
def join_semi(t):
    x, y = _sides(t)
    return x.semi_join(y, by={"o_custkey": "c_custkey"})


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select 2 * c_custkey from customer)")
def join_anti(t):
    x, y = _sides(t)
    return x.anti_join(y, by={"o_custkey": "c_custkey"})


@query("select a.*, b.r_regionkey as \"r_regionkey.y\", b.r_name as \"r_name.y\" from (select r_regionkey as \"r_regionkey.x\", r_name as \"r_name.x\" from region) a cross join region b")
def join_cross(t):
    return t("region").cross_join(t("region"))


@query(_JOIN.format("full join"))
def join_keep(t):
    x, y = _sides(t)
    return x.full_join(y, by={"o_custkey": "c_custkey"}, keep=True).select("o_orderkey", "o_custkey", "c_custkey", "c_name")


@query("select a.k, a.v as \"v.x\", b.v as \"v.y\" from (select n_nationkey as k, n_name as v from nation) a left join (select r_regionkey as k, r_name as v from region) b using (k)")
def join_suffix(t):
    return t("nation").select(k="n_nationkey", v="n_name").left_join(t("region").select(k="r_regionkey", v="r_name"), by="k")


@query("select c_custkey, o_orderkey from customer left join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1) on c_custkey = o_custkey")
def join_first_match(t):
    return t("customer").select("c_custkey").left_join(t("orders").select("o_custkey", "o_orderkey"), by={"c_custkey": "o_custkey"}, multiple=False, order_by="o_orderkey")


@query("with a as (select distinct nullif(l_returnflag, 'N') as f from lineitem), b as (select nullif(l_returnflag, 'N') as f, count(*) as n from lineitem group by 1) select a.f, n from a join b on a.f is not distinct from b.f")
def join_null_keys(t):
    x = t("lineitem").mutate(f=F.nullif(F.col("l_returnflag"), F.lit("N")))
    return x.distinct("f").inner_join(x.count("f"), by="f")


@query("select n_nationkey as k, n_name as v from nation union all select r_regionkey, r_name from region")
def union_all(t):
    return t("nation").select(k="n_nationkey", v="n_name").union_all(t("region").select(v="r_name", k="r_regionkey"))


@query("select l_returnflag as f from lineitem union select l_linestatus from lineitem")
def union(t):
    return t("lineitem").select(f="l_returnflag").union(t("lineitem").select(f="l_linestatus"))


@query("select n_nationkey, n_name, null::varchar as r_name from nation union all select null, null, r_name from region")
def bind_rows_missing(t):
    return bind_rows(t("nation").select("n_nationkey", "n_name"), t("region").select("r_name"))


@query("select a.r_regionkey, a.r_name, b.r_name as r_name_1 from region a join region b on a.r_regionkey + b.r_regionkey = 4")
def bind_columns(t):
    return bind_cols(t("region").arrange("r_regionkey"), t("region").arrange(desc("r_regionkey")).select("r_name"))


@query("select event_id, dense_rank() over (order by event_type, user_id) as group_id from events")
def group_id_sorted(t):
    return t("events").add_group_id("event_type", "user_id").select("event_id", "group_id")


@query("select event_id, dense_rank() over (order by f) as group_id from (select event_id, min(event_id) over (partition by user_id) as f from events)")
def group_id_first(t):
    return t("events").add_group_id("user_id", order=False, order_by="event_id").select("event_id", "group_id")


@query("select event_id, row_number() over (partition by user_id order by event_id) as row_id from events")
def row_id(t):
    return t("events").add_row_id("user_id", order_by="event_id").select("event_id", "row_id")


@query("select event_id, row_number() over (order by event_id) as row_id from events")
def row_id_global(t):
    return t("events").add_row_id(order_by="event_id").select("event_id", "row_id")


_RUN = "select event_id, user_id, case when event_type is not distinct from lag(event_type) over {w} and row_number() over {w} > 1 then 0 else 1 end as c from events"


@query(f"select event_id, sum(c) over (partition by user_id order by event_id)::bigint as consecutive_id from ({_RUN.format(w='(partition by user_id order by event_id)')})")
def consecutive_id_by(t):
    return t("events").add_consecutive_id("event_type", by="user_id", order_by="event_id").select("event_id", "consecutive_id")


@query(f"select event_id, sum(c) over (order by event_id)::bigint as consecutive_id from ({_RUN.format(w='(order by event_id)')})")
def consecutive_id(t):
    return t("events").add_consecutive_id("event_type", order_by="event_id").select("event_id", "consecutive_id")


_P = {"p0": 0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1}


@query("select l_suppkey, " + ", ".join(f"round(quantile_cont(l_quantity, {p}), 4) as {k}" for k, p in _P.items()) + " from lineitem group by 1")
def quantiles_wide(t):
    return t("lineitem").quantiles("l_quantity", by="l_suppkey", pivot="wide").mutate(**{k: F.round(k, 4) for k in _P})


@query(" union all ".join(f"select l_returnflag, '{k}' as \".quantile\", round(quantile_cont(l_extendedprice, {p}), 4) as l_extendedprice from lineitem group by 1" for k, p in _P.items()))
def quantiles_long(t):
    return t("lineitem").quantiles("l_extendedprice", by="l_returnflag").mutate(l_extendedprice=F.round("l_extendedprice", 4))


@query("with r as (select user_id, value, row_number() over (partition by user_id order by value) as i, count(*) over (partition by user_id) as n from events), h as (select *, least(greatest(0.3 * (n + 1), 1), n) as h from r) select user_id, round(sum(case when i = floor(h) then value * (1 - (h - floor(h))) when i = floor(h) + 1 then value * (h - floor(h)) else 0 end), 4) as p30 from h group by 1")
def quantiles_type6(t):
    return t("events").quantiles("value", probs=(0.3,), type=6, by="user_id", pivot="wide").mutate(p30=F.round("p30", 4))


@query("select * from (select distinct l_returnflag from lineitem), (select distinct l_linenumber from lineitem)")
def expand(t):
    return t("lineitem").expand("l_returnflag", "l_linenumber")


@query("select l_returnflag, month from (select distinct l_returnflag from lineitem), range(1, 13) r(month)")
def expand_by(t):
    return t("lineitem").expand(month=range(1, 13), by="l_returnflag").mutate(month=F.col("month").cast("long"))


@query("with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by all) select a.o_custkey, b.o_orderpriority, coalesce(n, 0) as n from (select distinct o_custkey from orders) a cross join (select distinct o_orderpriority from orders) b left join c on c.o_custkey = a.o_custkey and c.o_orderpriority = b.o_orderpriority")
def complete_fill(t):
    return t("orders").count("o_custkey", "o_orderpriority").complete("o_custkey", "o_orderpriority", fill={"n": 0})


@query("select * from (select distinct o_orderstatus from orders), (select distinct l_returnflag from lineitem)")
def crossing(t):
    return tables.crossing(t("orders").select("o_orderstatus"), t("lineitem").select("l_returnflag"))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def nesting(t):
    return tables.nesting(t("lineitem"), "l_returnflag", "l_linestatus")


@query("select distinct c_nationkey from customer")
def group_keys(t):
    return t("customer").group_by("c_nationkey").group_keys()


@query("select c_nationkey, count(*) as size from customer group by 1")
def group_size(t):
    return t("customer").group_by("c_nationkey").group_size()


@query("select c_custkey, dense_rank() over (order by c_nationkey) as group_index from customer")
def group_indices(t):
    return t("customer").group_by("c_nationkey").group_indices().ungroup().select("c_custkey", "group_index")


@query("select c_nationkey, count(*) as members, sum(c_custkey)::bigint as keys from customer group by 1")
def nest_by(t):
    return t("customer").nest_by("c_nationkey").mutate(members=F.size("data").cast("long"), keys=F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x["c_custkey"])).select("c_nationkey", "members", "keys")


@query("select c_custkey, row_number() over (order by c_custkey) as \".row_id\" from customer")
def rowwise(t):
    return Tidy(t("customer").df, order_by=["c_custkey"]).rowwise().ungroup().select("c_custkey", ".row_id")


@query("select l_returnflag, min(l_quantity) as q from lineitem group by 1 union all select l_returnflag, max(l_quantity) from lineitem group by 1")
def reframe_range(t):
    ends = e.Expr(lambda c: F.array(F.min("l_quantity"), F.max("l_quantity")))
    return t("lineitem").reframe(q=ends, by="l_returnflag")


@query("select r_regionkey, upper(r_name) as r_name from region")
def pipe_function(t):
    return t("region").mutate(r_name=e.col("r_name").pipe(F.upper))


# -- names with dots: every verb takes them as they are

_DOTTED = "select event_id as \"e.id\", user_id as \"u.id\", event_type as \"e.type\", value as \"v.x\" from events"


def _dotted(t):
    return t("events").select(**{"e.id": "event_id", "u.id": "user_id", "e.type": "event_type", "v.x": "value"})


@query(f'select "u.id", round(avg("v.x"), 4) as "m.x", count(*) as n from ({_DOTTED}) group by 1')
def dotted_summarise(t):
    return _dotted(t).group_by("u.id").summarise(**{"m.x": _r(e.mean("v.x"))}, n=e.n())


@query(f'select *, round("v.x" / sum("v.x") over (partition by "u.id"), 6) as "d.x", lag("v.x") over (partition by "u.id" order by "e.id") as "p.x" from ({_DOTTED})')
def dotted_mutate(t):
    return _dotted(t).mutate(**{"d.x": _r(e.col("v.x") / e.sum("v.x"), 6), "p.x": e.lag("v.x")}, by="u.id", order_by="e.id")


@query(f'select "u.id", "v.x" from ({_DOTTED}) qualify "v.x" > avg("v.x") over (partition by "u.id")')
def dotted_filter(t):
    return _dotted(t).filter(e.col("v.x") > e.mean("v.x"), by="u.id", order_by="e.id").select("u.id", "v.x")


@query(f'select * from ({_DOTTED}) qualify row_number() over (partition by "u.id" order by "e.id") <= 2')
def dotted_slice(t):
    return _dotted(t).slice_head(2, by="u.id", order_by="e.id")


@query(f'select * from ({_DOTTED}) qualify rank() over (partition by "u.id" order by "v.x" desc) <= 2')
def dotted_slice_max(t):
    return _dotted(t).slice_max("v.x", 2, by="u.id")


@query(f'select "u.id", "e.type", count(*) as n from ({_DOTTED}) group by all')
def dotted_count(t):
    return _dotted(t).count("u.id", "e.type")


@query(f'select distinct "u.id", "e.type" from ({_DOTTED})')
def dotted_distinct(t):
    return _dotted(t).distinct("u.id", "e.type")


@query(f'select "e.id", "u.id" from ({_DOTTED}) qualify row_number() over (partition by "u.id" order by "e.id") > 1')
def dotted_duplicates(t):
    return _dotted(t).duplicates("u.id", keep_all=True, order_by="e.id").select("e.id", "u.id")


@query(f'select "u.id", round(quantile_cont("v.x", 0.25), 4) as p25 from ({_DOTTED}) group by 1')
def dotted_quantiles(t):
    return _dotted(t).quantiles("v.x", probs=(0.25,), by="u.id", pivot="wide").mutate(p25=F.round("p25", 4))


@query(f'select "e.id", dense_rank() over (order by "u.id", "e.type") as "g.id", row_number() over (partition by "u.id" order by "e.id") as "r.id" from ({_DOTTED})')
def dotted_ids(t):
    return _dotted(t).add_group_id("u.id", "e.type", name="g.id").add_row_id("u.id", name="r.id", order_by="e.id").select("e.id", "g.id", "r.id")


@query(f'select a."e.id", a."v.x" as "v.x.x", b."v.x" as "v.x.y" from ({_DOTTED}) a left join (select "u.id", max("v.x") as "v.x" from ({_DOTTED}) group by 1) b using ("u.id")')
def dotted_join(t):
    x = _dotted(t)
    return x.left_join(x.summarise(**{"v.x": e.max("v.x")}, by="u.id"), by="u.id").select("e.id", "v.x.x", "v.x.y")


@query(f'select "e.id", last_value(case when "e.id" % 3 = 0 then "v.x" end ignore nulls) over (partition by "u.id" order by "e.id") as "v.x" from ({_DOTTED})')
def dotted_fill(t):
    return _dotted(t).mutate(**{"v.x": F.when(F.col("`e.id`") % 3 == 0, F.col("`v.x`"))}).fill("v.x", by="u.id", order_by="e.id").select("e.id", "v.x")


@query(f'select "u.id", "e.type" from (select distinct "u.id" from ({_DOTTED})), (select distinct "e.type" from ({_DOTTED}))')
def dotted_expand(t):
    return _dotted(t).expand("u.id", "e.type")


@query(f'select *, row_number() over (order by "e.type", "e.id") as "r.id" from (select "e.type", "e.id" from ({_DOTTED}))')
def dotted_arrange(t):
    return _dotted(t).select("e.type", "e.id").arrange("e.type", "e.id").add_row_id(name="r.id")


# -- without groups: no task sees all rows


@query("select event_id, round(value / sum(value) over (), 8) as d, count(*) over () as n, count(distinct event_type) over () as kinds from events")
def mutate_ungrouped(t):
    return t("events").mutate(d=_r(e.col("value") / e.sum("value"), 8), n=e.n(), kinds=e.n_distinct("event_type")).select("event_id", "d", "n", "kinds")


@query("select event_id, row_number() over (order by event_id) as rn, lag(value) over (order by event_id) as prev, lead(value, 2, -1.0) over (order by event_id) as next2 from events")
def mutate_ungrouped_ordered(t):
    return t("events").mutate(rn=e.row_number(), prev=e.lag("value"), next2=e.lead("value", 2, -1.0), order_by="event_id").select("event_id", "rn", "prev", "next2")


@query(f"select event_id, last_value(v ignore nulls) over (order by event_id) as v from ({_GAPS})")
def fill_ungrouped(t):
    return _gaps(t).fill("v", order_by="event_id").select("event_id", "v")


@query("select * from events qualify rank() over (order by value desc nulls last) <= 7")
def slice_max_ungrouped(t):
    return t("events").slice_max("value", 7)


@query("select * from events qualify row_number() over (order by event_id desc) <= 9")
def slice_tail_ungrouped(t):
    return t("events").slice_tail(9, order_by="event_id")


@query("select event_id, user_id, kinds from (select event_id, user_id, event_type from events) join (select user_id, count(distinct event_type) as kinds from events group by 1) using (user_id)")
def mutate_n_distinct(t):
    return t("events").mutate(kinds=e.n_distinct("event_type"), by="user_id").select("event_id", "user_id", "kinds")


@query("select user_id, arg_max(event_type, event_id) as newest from events group by 1")
def summarise_first_descending(t):
    return t("events").summarise(newest=e.first("event_type"), by="user_id", order_by=desc("event_id"))


# -- groups and rows


@query("select c_custkey, dense_rank() over (order by c_nationkey) as id, row_number() over (order by c_custkey) as row from customer")
def cur_group_helpers(t):
    x = Tidy(t("customer").arrange("c_custkey").df).mutate(id=e.cur_group_id(), row=e.cur_group_rows(), by="c_nationkey")
    return x.select("c_custkey", "id", "row")


@query("select c_nationkey, dense_rank() over (order by c_nationkey) as id, count(*) as n from customer group by c_nationkey")
def summarise_group_id(t):
    return t("customer").summarise(id=e.cur_group_id(), n=e.n(), by="c_nationkey")


@query("select c_custkey, c_nationkey as key from customer")
def cur_group(t):
    return t("customer").mutate(g=e.cur_group(), by="c_nationkey").mutate(key=F.col("g.c_nationkey")).select("c_custkey", "key")


@query("select l_orderkey, l_linenumber, greatest(l_quantity, l_tax, l_discount) as hi, l_quantity as q, (l_quantity > 45 or l_tax > 45) as any_, (l_quantity > 1 and l_tax > 0) as all_ from lineitem")
def row_helpers(t):
    x = t("lineitem").mutate(hi=e.c_across("l_quantity", "l_tax", "l_discount").pipe(F.array_max), q=e.pick("l_quantity", "l_tax").pipe(lambda c: c["l_quantity"]), any_=e.if_any(["l_quantity", "l_tax"], lambda c: c > 45))
    return x.mutate(all_=e.if_all(["l_quantity"], lambda c: c > 1) & e.if_all(["l_tax"], lambda c: c > 0)).select("l_orderkey", "l_linenumber", "hi", "q", "any_", "all_")


@query("select l_returnflag, min(l_tax) as l_tax_lo, max(l_tax) as l_tax_hi, min(l_discount) as l_discount_lo, max(l_discount) as l_discount_hi from lineitem group by 1")
def across_unpack(t):
    ends = lambda x: e.Expr(lambda c: F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")))
    return t("lineitem").summarise(e.across(["l_tax", "l_discount"], ends, unpack=True), by="l_returnflag")


@query("select l_returnflag, 'l_tax:' || count(l_tax) as l_tax from lineitem group by 1")
def across_cur_column(t):
    def named(x):
        name = e.cur_column()
        return e.Expr(lambda c: F.concat(F.lit(name + ":"), F.count(x)))

    return t("lineitem").summarise(e.across("l_tax", named), by="l_returnflag")


@query("select c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) as spread from customer group by 1")
def summarise_function(t):
    return t("customer").summarise(spread=_r(e.group_function(lambda x: x.max() - x.min(), "double", "c_acctbal")), by="c_nationkey")


@query("select c_custkey, c_acctbal - min(c_acctbal) over (partition by c_nationkey) as above from customer")
def mutate_function(t):
    x = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return x.mutate(function=lambda d: d.assign(above=d["c_acctbal"] - d["c_acctbal"].min())[["c_custkey", "above"]], schema="c_custkey long, above double", by="c_nationkey")


@query("select c_mktsegment, round(avg(c_acctbal), 4) as m, round(stddev_samp(c_acctbal), 4) as s, max(c_acctbal) as hi from customer group by 1")
def summarise_without_optimisations(t):
    settings.disable_optimisations()
    try:
        return t("customer").summarise(m=_r(e.mean("c_acctbal")), s=_r(e.sd("c_acctbal")), hi=e.max("c_acctbal"), by="c_mktsegment")
    finally:
        settings.enable_optimisations()


@query("select c_nationkey, list(i order by i) as rows from (select c_nationkey, row_number() over (order by c_custkey) as i from customer) group by 1")
def group_data(t):
    return Tidy(t("customer").arrange("c_custkey").df).group_by("c_nationkey").group_data()


@query("select list(i order by i) as rows from (select c_nationkey, row_number() over (order by c_custkey) as i from customer) group by c_nationkey")
def group_rows(t):
    return Tidy(t("customer").arrange("c_custkey").df).group_by("c_nationkey").group_rows()


def _made(t, rows, schema):
    return t("region").df.sparkSession.createDataFrame(rows, schema)


@query("select count(distinct c_nationkey) as n, true as ordered, 'c_nationkey' as vars, true as flag from customer")
def group_facts(t):
    g = t("customer").group_by("c_nationkey")
    return _made(t, [(g.n_groups(), g.group_ordered(), ",".join(g.group_vars()), settings.group_by_order_default(g))], "n long, ordered boolean, vars string, flag boolean")


@query("select r_name as part, count(*) as n from region group by 1")
def group_split(t):
    parts = t("region").group_by("r_name").group_split(names=True)
    return bind_rows(*(p.mutate(part=F.lit(k)).count("part") for k, p in ((k, tidy(x)) for k, x in parts.items())))


@query("select 0::bigint as n, null::double as total")
def summarise_empty(t):
    return t("orders").filter(F.lit(False)).summarise(n=e.n(), total=e.sum("o_totalprice"))


@query("select user_id, count(*) as n, least(count(*), 5) as drawn from events group by 1")
def slice_sample_sizes(t):
    return t("events").count("user_id").left_join(t("events").slice_sample(5, by="user_id", seed=1).count("user_id", name="drawn"), by="user_id")


@query("select user_id, event_type, count(*) as n from events group by all")
def group_by_add(t):
    return t("events").group_by("user_id").group_by("event_type", add=True).summarise(n=e.n())


# -- names and tables


@query("select n_nationkey as key, n_name as name, n_regionkey from nation")
def rename(t):
    return t("nation").rename(key="n_nationkey", name="n_name")


@query("select r_name as x from region")
def pull(t):
    return _made(t, [(x,) for x in t("region").pull("r_name")], "x string")


@query("select l_orderkey, l_tax, l_shipdate from lineitem")
def select_more_helpers(t):
    return t("lineitem").select(all_of(["l_orderkey"]), any_of(["l_tax", "none"]), nothing(), last_col())


@query("select l_partkey, l_suppkey from lineitem")
def select_matches(t):
    return t("lineitem").select(matches("_(part|supp)key$") & everything() & ~nothing())


@query("select 1 as x1, 2 as x2, 'a' as y")
def select_num_range(t):
    return tables.new_tbl(t("region").df.sparkSession, x1=1, x2=2, x3=3, y="a").select(num_range("x", range(1, 3)), "y").mutate(x1=F.col("x1").cast("int"), x2=F.col("x2").cast("int"))


@query("select * from (values (1, 'k', 2), (2, 'k', 4)) t(x, y, z)")
def new_tbl(t):
    return tables.new_tbl(t("region").df.sparkSession, x=[1, 2], y="k", z=lambda m: [2 * v for v in m["x"]]).mutate(x=F.col("x").cast("int"), z=F.col("z").cast("int"))


@query("select 7 as a, 'q' as b")
def as_tbl(t):
    return tables.as_tbl(tables.as_tbl(_made(t, [(7, "q")], "a int, b string")))


@query("select * from (values ('a', 1), ('b', 2)) t(name, value)")
def enframe(t):
    return tables.enframe({"a": 1, "b": 2}, t("region").df.sparkSession).mutate(value=F.col("value").cast("int"))


@query("select 'r_name' as name, list(r_name order by r_name) as value from region")
def enframe_table(t):
    return tables.enframe(t("region").select("r_name")).mutate(value=F.sort_array("value"))


@query("select r_regionkey as k, r_name as v from region")
def deframe(t):
    return _made(t, list(tables.deframe(t("region").select("r_regionkey", "r_name")).items()), "k long, v string").withColumn("k", F.col("k").cast(t("region").df.schema["r_regionkey"].dataType))


@query("select 'a=1,b=2,col_1=9' as x, '9' as y")
def list_tidy(t):
    got = tables.list_tidy(9, named=True, a=1, b=lambda m: m["a"] + 1)
    return _made(t, [(",".join(f"{k}={got[k]}" for k in sorted(got)), str(tables.list_tidy(9)[0]))], "x string, y string")


@query("select 'lgamma,mod,sinpi' as x")
def group_unaware(t):
    return _made(t, [(",".join(sorted({"mod", "lgamma", "sinpi", "mean"} & set(api.get_group_unaware_fns()))),)], "x string")


@query("select n_nationkey, n_name, r_name, 'x' as one from nation, (select r_name from region where r_regionkey = 0)")
def bind_columns_recycled(t):
    return bind_cols(t("nation").select("n_nationkey", "n_name"), t("region").filter(F.col("r_regionkey") == 0).select("r_name"), one="x")


@query("select a.r_regionkey, b.n from region a join (select r_regionkey, count(*) as n from region group by all) b using (r_regionkey)")
def join_complex_keys(t):
    x = t("region").mutate(k=F.create_map(F.lit("b"), "r_name", F.lit("a"), "r_name"), s=F.struct("r_regionkey"))
    y = t("region").mutate(k=F.create_map(F.lit("a"), "r_name", F.lit("b"), "r_name"), s=F.struct("r_regionkey"), n=F.lit(1).cast("long")).select("k", "s", "n")
    return x.inner_join(y, by=["k", "s"]).select("r_regionkey", "n")


@query("select dense_rank() over (order by c_nationkey) as group_id from customer")
def group_id(t):
    return api.group_id(t("customer"), "c_nationkey")


@query("select row_number() over (partition by c_nationkey order by c_custkey) as row_id from customer")
def row_id_plain(t):
    return api.row_id(t("customer"), "c_nationkey", order_by="c_custkey")


@query(f"select sum(c) over (order by event_id)::bigint as consecutive_id from ({_RUN.format(w='(order by event_id)')})")
def consecutive_id_plain(t):
    return api.f_consecutive_id(t("events"), "event_type", order_by="event_id")


# -- scalar functions


@query("select c_custkey, round(exp(x), 8) as e, round(ln(x + 1), 8) as l, round(ln(x + 1) / ln(2), 8) as l2, round(exp(x) - 1, 8) as em, round(ln(1 + x), 8) as lp, sign(c_acctbal)::int as s, trunc(c_acctbal)::bigint as t from (select *, c_custkey % 10 / 10.0 as x from customer)")
def scalars_exponential(t):
    x = F.col("c_custkey") % 10 / 10
    return t("customer").mutate(e=_r(F.exp(x), 8), l=_r(s.log(x + 1), 8), l2=_r(s.log(x + 1, 2), 8), em=_r(s.expm1(x), 8), lp=_r(s.log1p(x), 8), s=F.sign("c_acctbal").cast("int"), t=s.trunc(F.col("c_acctbal")).cast("long")).select("c_custkey", "e", "l", "l2", "em", "lp", "s", "t")


@query("select c_custkey, round(cos(x), 8) as c, round(sin(x), 8) as s, round(tan(x), 8) as t, round(acos(x), 8) as ac, round(asin(x), 8) as asi, round(atan(x), 8) as at, round(cosh(x), 8) as ch, round(sinh(x), 8) as sh, round(tanh(x), 8) as th, round(asinh(x), 8) as ash, round(acosh(1 + x), 8) as ach, round(atanh(x), 8) as ath, round(cos(pi() * x), 8) + 0.0 as cp, round(sin(pi() * x), 8) as sp, round(tan(pi() * x / 3), 8) as tp from (select c_custkey, c_custkey % 10 / 10.0 as x from customer)")
def scalars_trigonometric(t):
    x = F.col("c_custkey") % 10 / 10
    made = {"c": F.cos(x), "s": F.sin(x), "t": F.tan(x), "ac": F.acos(x), "asi": F.asin(x), "at": F.atan(x), "ch": F.cosh(x), "sh": F.sinh(x), "th": F.tanh(x), "ash": F.asinh(x), "ach": F.acosh(1 + x), "ath": F.atanh(x), "cp": s.cospi(x), "sp": s.sinpi(x), "tp": s.tanpi(x / 3)}
    return t("customer").mutate(**{k: _r(v, 8) + F.lit(0.0) for k, v in made.items()}).select("c_custkey", *made)


@query("select c_custkey, round(lgamma(x), 8) as lg, round(gamma(x), 6) as g, gcd(c_custkey, 36)::bigint as d, lcm(c_custkey, 36)::bigint as m from (select c_custkey, c_custkey % 60 / 4.0 + 0.25 as x from customer)")
def scalars_gamma(t):
    x = F.col("c_custkey") % 60 / 4 + 0.25
    return t("customer").mutate(lg=_r(s.lgamma(x), 8), g=_r(s.gamma(x), 6), d=s.gcd(F.col("c_custkey"), F.lit(36)), m=s.lcm(F.col("c_custkey"), F.lit(36))).select("c_custkey", "lg", "g", "d", "m")


@query("select c_custkey, round(sum(1.0 / k) - 0.5772156649015329, 8) as di, round(pi() * pi() / 6 - coalesce(sum(1.0 / (k * k)), 0), 8) as tri from customer, range(1, 41) r(k) where k <= 1 + c_custkey % 40 group by all")
def scalars_digamma(t):
    x = F.col("c_custkey") % 40 + 2
    return t("customer").mutate(di=_r(s.digamma(x), 8), tri=_r(s.trigamma(x), 8)).select("c_custkey", "di", "tri")


@query("select o_orderkey, x, (x % 7 + 7) % 7 as m, floor((x - (x % 7 + 7) % 7) / 7)::bigint as q from (select o_orderkey, case when o_orderkey % 2 = 0 then 1 else -1 end * (9007199254740993 + o_orderkey) as x from orders)".replace("floor((x - (x % 7 + 7) % 7) / 7)", "((x - (x % 7 + 7) % 7) // 7)"))
def scalars_whole_numbers(t):
    x = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * (F.lit(9007199254740993) + F.col("o_orderkey"))
    return t("orders").mutate(x=x).mutate(m=s.mod(F.col("x"), F.lit(7)), q=s.idiv(F.col("x"), F.lit(7))).select("o_orderkey", "x", "m", "q")


@query("select event_type, date_trunc('day', ts) as window_start, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_windowed(t):
    return windowed(t("events").df, "ts", "1 day", "1 hour", "event_type", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 2))
