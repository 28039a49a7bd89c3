import math
import re

import pytest
from pyspark.sql import functions as F

from verbena import api as v
from verbena.functions import expressions as e
from verbena.functions import scalars as s
from verbena.operators.frame import bind_rows, desc, tidy


def rows(t, *keys):
    return sorted((tuple(r) for r in tidy(t).df.collect()), key=repr)


@pytest.fixture()
def nulls(spark):
    return tidy(spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("a", float("nan"), 3), ("b", None, 4), (None, 5.0, 5)], "g string, x double, i int"))


def test_aggregates_skip_missing(nulls):
    got = {r.g: r for r in nulls.summarise(m=e.mean("x"), n=e.n(), k=e.n_distinct("x"), f=e.first("x"), l=e.last("x"), strict=e.mean("x", na_rm=False), by="g", order_by="i").df.collect()}
    assert (got["a"].m, got["a"].n, got["a"].k, got["a"].f, got["a"].l, got["a"].strict) == (1.0, 3, 1, 1.0, 1.0, None)
    assert got["b"].m is None and got["b"].f is None and got[None].m == 5.0
    assert [r.g for r in nulls.summarise(n=e.n(), by="g").df.collect()] == ["a", "b", None]


def test_empty(nulls):
    none = nulls.filter(F.lit(False))
    assert rows(none.count()) == [(0,)] and rows(none.count("g")) == [] and rows(none.summarise(n=e.n())) == [(0,)]
    for t in (none.distinct(), none.slice_head(2), none.duplicates("g", keep_all=True), none.fill("x", order_by="i"), none.quantiles("x", by="g"), none.complete("g"), none.add_group_id("g"), none.arrange("x")):
        assert rows(t) == []


def test_fill(spark):
    x = tidy(spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, None), (5, 5.0), (6, float("nan"))], "id int, x double"))
    assert [r[1] for r in rows(x.fill("x", limit=2, order_by="id"))] == [1, 1, 1, None, 5, 5]
    assert [r[1] for r in rows(x.fill("x", direction="backwards", order_by="id"))] == [1, 5, 5, 5, 5, None]


def test_joins_match_nulls(spark):
    a = tidy(spark.createDataFrame([(1, "l1"), (None, "l2"), (3, "l3")], "k int, a string"))
    b = tidy(spark.createDataFrame([(1, "r1"), (None, "r2"), (4, "r4"), (1, "r0")], "k int, b string"))
    assert len(rows(a.full_join(b))) == 5 and len(rows(a.left_join(b, multiple=False, order_by="b"))) == 3
    assert rows(a.anti_join(b)) == [(3, "l3")] and len(rows(a.semi_join(b))) == 2
    assert a.inner_join(b, keep=True).df.columns == ["k.x", "a", "k.y", "b"]
    with pytest.raises(ValueError):
        a.left_join(b.rename(z="k"))


def test_duplicates(spark):
    cols = "x1 string, x2 string, x3 string, x4 string, group double"
    t = tidy(spark.createDataFrame(list(zip("aabcdea", "aabcaba", "aabab" + "ea", "aaaabba", [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0], strict=True)), cols))
    n = lambda x: x.df.count()
    assert n(t.duplicates(both_ways=True)) == 2 and n(t.duplicates()) == 1
    assert n(t.duplicates("x1", "x2", "x3", "x4", both_ways=True)) == 3 and n(t.duplicates("x2", both_ways=True)) == 6
    assert n(t.group_by("group").duplicates("x2", both_ways=True)) == 2


@pytest.mark.parametrize("kind, want", [(5, (1.2, 2.25, 28.8)), (6, (1, 2, 32)), (7, (1.6, 2.5, 22.4)), (8, (1.066667, 2.166667, 30.933333)), (9, (1.1, 2.1875, 30.4))])
def test_quantiles(spark, kind, want):
    t = tidy(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4, 8, 16, 32)], "x double"))
    assert rows(t.quantiles("x", probs=(0.1, 0.25, 0.9), type=kind, pivot="wide"))[0] == pytest.approx(want, abs=1e-5)


def test_slices(nulls):
    with pytest.raises(ValueError):
        nulls.slice(1, -1)
    assert [r.i for r in nulls.slice(3, 0, 1, 1, 99, order_by="i", keep_order=True).df.collect()] == [1, 1, 3]
    assert rows(nulls.slice_tail(0, order_by="i")) == [] and len(rows(nulls.slice_sample(2, replace=True))) == 2
    assert [r[2] for r in rows(nulls.slice_max("x", 1, order_by="i"))] == [5]
    assert [r.i for r in nulls.arrange(desc("x"), "i").df.collect()][:2] == [5, 1]


def test_mutate(spark):
    t = tidy(spark.createDataFrame([(1, 2)], "x int, y int"))
    assert rows(t.mutate(y="x", x="y")) == [(1, 1)] and t.mutate(x=None).df.columns == ["y"]
    assert t.mutate(z=F.col("x") + 1, keep="used").df.columns == ["x", "z"] and t.mutate(z=F.col("x") + 1, keep="unused").df.columns == ["y", "z"]


def test_scalars(spark):
    d = spark.createDataFrame([(7.0, -3.0, 0.0)], "a double, b double, z double")
    r = d.select(s.mod(F.col("a"), F.col("b")), s.idiv(F.col("a"), F.col("b")), s.div(F.col("a"), F.col("z")), s.round(F.lit(2.5)), s.signif(F.lit(123456.0), 2), s.trunc(F.lit(-2.7)), s.lgamma(F.col("a")), s.digamma(F.col("a")), s.trigamma(F.col("a")), s.gcd(F.lit(12), F.lit(18)), s.lcm(F.lit(4), F.lit(6)), s.log(F.lit(-1.0))).first()
    assert tuple(r[:6]) == (-2.0, -3, float("inf"), 2.0, 120000.0, -2.0) and r[6] == pytest.approx(math.lgamma(7))
    assert r[7] == pytest.approx(1.872784335) and r[8] == pytest.approx(0.153545177) and r[9:11] == (6, 12) and math.isnan(r[11])


def test_tables(spark, nulls):
    assert v.deframe(v.enframe({"a": 1, "b": 2}, spark)) == {"a": 1, "b": 2} and v.list_tidy(a=1, b=lambda x: x["a"] + 1) == {"a": 1, "b": 2}
    assert rows(v.new_tbl(spark, x=[1, 2], y=3)) == [(1, 3), (2, 3)] and nulls.n_groups() == 1 and len(nulls.group_by("g").group_split()) == 3
    assert bind_rows(nulls, None, [nulls]).df.count() == 10 and v.f_mutate(nulls, z=1).df.columns[-1] == "z"
    assert [tuple(r) for r in tidy(spark.createDataFrame([("x",)], "g string")).group_by("g", levels={"g": ["x", "y"]}).summarise(n=e.n()).df.collect()] == [("x", 1), ("y", None)]


def test_order_queries_return_all_rows(spark):
    from verbena.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    got = QUERIES["arrange_desc_nulls_all"](spark, sf_dir).orderBy("row_id").collect()
    missing = customers.filter("c_acctbal <= 0").count()
    assert len(got) == customers.count() and [r.b is None for r in got] == [False] * (len(got) - missing) + [True] * missing and missing
    assert QUERIES["arrange_by_group_all"](spark, sf_dir).count() == len(got)
    counts = QUERIES["count_sort_all"](spark, sf_dir).orderBy("row_id").collect()
    assert len(counts) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert [(-r.n, r.l_suppkey) for r in counts] == sorted((-r.n, r.l_suppkey) for r in counts)


@pytest.fixture()
def dotted(spark):
    return tidy(spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 2), ("y", None, 3), (None, 2.0, 4)], "`g.h` string, `a.b` double, `i.d` int"))


def test_every_verb_takes_dotted_names(dotted):
    t, g = dotted, dotted.group_by("g.h")
    assert t.select("a.b", **{"n.w": "i.d"}).df.columns == ["a.b", "n.w"] and t.rename(**{"q.r": "a.b"}).df.columns == ["g.h", "q.r", "i.d"]
    assert t.pull("i.d") == [1, 2, 3, 4] and t.remove_rows_if_any_na("a.b").df.count() == 3 and t.remove_rows_if_all_na().df.count() == 4
    assert [r[-1] for r in rows(g.mutate(**{"m.x": e.mean("a.b")}))].count(2.0) == 3 and t.filter(e.col("a.b") > 1).df.count() == 2
    assert [r[0] for r in g.group_keys().df.collect()] == ["x", "y", None]
    assert g.n_groups() == 3 and len(rows(g.group_data())) == 3 and len(rows(g.group_indices())) == 4 and len(g.group_split()) == 3
    assert len(rows(t.nest_by("g.h"))) == 3 and len(rows(g.nest_by("i.d", add=True))) == 4
    assert len(rows(g.summarise(**{"m.x": e.max("a.b")}))) == 3
    assert len(rows(t.count("g.h", sort=True))) == 3 and len(rows(t.add_count("g.h", sort=True))) == 4 and len(rows(t.distinct("g.h", keep_all=True, order_by="i.d"))) == 3
    assert len(rows(t.duplicates("g.h", add_count=True, drop_empty=True, order_by="i.d"))) == 1
    for kind in (6, 7):
        assert len(rows(t.quantiles("a.b", by="g.h", type=kind))) == 15 and len(rows(t.quantiles("a.b", type=kind, pivot="wide"))) == 1
    for how in ("left", "right", "inner", "full", "semi", "anti"):
        getattr(t, f"{how}_join")(t, by="g.h", **({"multiple": False, "order_by": "i.d"} if how == "left" else {})).df.collect()
    assert len(rows(t.cross_join(t))) == 16 and len(rows(t.union(t))) == 4 and len(rows(bind_rows(t, t))) == 8
    assert len(rows(t.add_group_id("g.h", name="k.k"))) == 4 and len(rows(t.add_group_id("g.h", order=False, order_by="i.d"))) == 4
    assert len(rows(t.add_row_id("g.h", name="k.k", order_by="i.d"))) == 4 and len(rows(t.add_consecutive_id("g.h", name="k.k", order_by="i.d"))) == 4
    assert [r["i.d"] for r in t.arrange(desc("a.b")).df.collect()] == [2, 4, 1, 3]
    for x in (t.slice(2, order_by="i.d"), t.slice_head(1, order_by="i.d"), t.slice_tail(1, order_by="i.d"), t.slice_min("a.b"), t.slice_max("a.b"), t.slice_sample(1)):
        assert len(rows(x)) == 1
    assert len(rows(g.slice_sample(1, replace=True))) == 3 and len(rows(t.expand("g.h", "i.d"))) == 12 and len(rows(t.complete("g.h", "i.d", fill={"a.b": 0.0}))) == 12
    assert [r[1] for r in rows(t.fill("a.b", order_by="i.d").arrange("i.d"))].count(3.0) == 2 and len(rows(g.fill("a.b", order_by="i.d"))) == 4
    assert len(rows(v.bind_cols(t, t))) == 4 and len(rows(v.nesting(t, "g.h", "a.b"))) == 4 and len(rows(v.enframe(t))) == 3


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
def test_ordered_verbs_without_groups(spark, monkeypatch, stretch):
    from verbena.operators import frame

    monkeypatch.setattr(frame, "STRETCH", stretch)
    x = [5.0, None, None, 2.0, 2.0, None, None, None, 7.0, 7.0, 1.0]
    t = tidy(spark.createDataFrame(list(enumerate(x)), "i int, x double").repartition(3))
    assert [r.x for r in t.fill("x", limit=2, order_by="i").df.orderBy("i").collect()] == [5, 5, 5, 2, 2, 2, 2, None, 7, 7, 1]
    assert [r.x for r in t.fill("x", direction="backwards", order_by="i").df.orderBy("i").collect()] == [5, 2, 2, 2, 2, 7, 7, 7, 7, 7, 1]
    assert [r.consecutive_id for r in t.add_consecutive_id("x", order_by="i").df.orderBy("i").collect()] == [1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6]
    got = t.mutate(a=e.lag("x", 1, -1.0), b=e.lead("i", 2), n=e.row_number(), order_by="i").df.orderBy("i").collect()
    assert [r.a for r in got] == [-1.0, *x[:-1]] and [r.b for r in got] == [*range(2, 11), None, None] and [r.n for r in got] == list(range(1, 12))


def test_no_plan_takes_all_rows_to_one_task(spark):
    t = tidy(spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("x")))
    many = [
        t.mutate(m=e.mean("x"), n=e.n(), k=e.n_distinct("x")), t.mutate(r=e.row_number(), p=e.lag("x"), order_by="id"), t.filter(e.col("x") > e.mean("x")), t.add_count(), t.fill("x", order_by="id"),
        t.slice(3, order_by="id"), t.slice_head(3, order_by="id"), t.slice_tail(prop=0.1, order_by="id"), t.slice_max("x", 2), t.slice_min("x", prop=0.2), t.slice_sample(5), t.quantiles("x", type=6), t.add_consecutive_id("x", order_by="id"),
        t.distinct("x", keep_all=True, order_by="id"),
    ]
    for x in many:
        windows = re.findall(r"Window \[(.*)", x.df._jdf.queryExecution().optimizedPlan().toString())
        # without partition keys only a window over one row for each stretch is allowed
        assert all("windowspecdefinition(__stretch" in w or "windowspecdefinition(x" in w for w in windows), windows
        assert x.df.count() >= 1
    plan = t.mutate(k=e.n_distinct("x"), by="id").df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_bind_cols_recycles(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(9,)], "y int")
    assert rows(v.bind_cols(a, b, z="k", w=[3, 4])) == [(1, 9, "k", 3), (2, 9, "k", 4)]
    with pytest.raises(Exception, match="number of rows"):
        v.bind_cols(a, b, recycle=False).df.collect()
    assert rows(v.bind_cols(b, b)) == [(9, 9)]


def test_optimisation_switch(nulls):
    args = {k: getattr(e, k)("x") for k in ("sum", "prod", "mean", "median", "min", "max", "sd", "var")}
    fast = rows(nulls.mutate(x=F.col("x") + F.col("i")).summarise(**args, by="g"))
    v.disable_optimisations()
    try:
        slow = nulls.mutate(x=F.col("x") + F.col("i")).summarise(**args, by="g")
        assert "lambda" in slow.df._jdf.queryExecution().optimizedPlan().toString()
        assert [tuple(x for x in r if x is not None) for r in rows(slow)][:2] == [tuple(x for x in r if x is not None) for r in fast][:2]
    finally:
        v.enable_optimisations()


def test_helpers_about_groups(spark, nulls):
    got = nulls.summarise(id=e.cur_group_id(), at=e.cur_group_rows(), by="g").df.collect()
    assert [(r.g, r.id, r.at) for r in got] == [("a", 1, [1, 2, 3]), ("b", 2, [4]), (None, 3, [5])]
    assert v.group_by_order_default(nulls.group_by("g", order=False)) is False and v.group_by_order_default() is True
    assert nulls.summarise(f=e.first("i"), l=e.last("i"), by="g", order_by=desc("i")).df.collect()[0][1:] == (3, 1)
    with pytest.raises(ValueError):
        e.cur_column()
    assert "mod" in v.get_group_unaware_fns() and "+" not in v.get_group_unaware_fns()


def test_whole_numbers_and_gamma(spark):
    d = spark.createDataFrame([(2**53 + 1, 3), (-(2**53) - 1, 3), (7, -3), (7, 0)], "a long, b long")
    got = [tuple(r) for r in d.select(s.mod(F.col("a"), F.col("b")), s.idiv(F.col("a"), F.col("b"))).collect()]
    assert got == [((2**53 + 1) % 3, (2**53 + 1) // 3), ((-(2**53) - 1) % 3, (-(2**53) - 1) // 3), (-2, -3), (None, None)]
    xs = [-1e6 - 0.5, -3.7, -0.5, 0.1, 0.5, 1.0, 2.5, 11.9, 170.0, 1e5, 1e12]
    rows_ = spark.createDataFrame([(x,) for x in xs], "x double").select("x", s.lgamma(F.col("x")).alias("l"), s.gamma(F.col("x")).alias("g"), s.digamma(F.col("x")).alias("d"), s.trigamma(F.col("x")).alias("t")).collect()
    for r in rows_:
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-12)
        if -200 < r.x < 171:
            assert r.g == pytest.approx(math.gamma(r.x), rel=1e-11)
    assert rows_[5].d == pytest.approx(-0.5772156649015329) and rows_[5].t == pytest.approx(math.pi**2 / 6) and rows_[2].d == pytest.approx(0.03648997397857652)


def test_stream(spark, tmp_path):
    from verbena.streaming import windowed

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(open(path, "rb").read())
    made = lambda df: windowed(df, "ts", "1 day", "1 hour", "event_type", n=F.count(F.lit(1)))
    query = made(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.table("windowed")) == rows(made(batch))


def test_tables_with_unnamed_columns(spark):
    assert v.new_tbl(spark, [1, 2], x=3).df.columns == ["col_1", "x"] and v.list_tidy(1, 2) == [1, 2] and v.list_tidy(1, a=2) == {"col_1": 1, "a": 2}
    with pytest.raises(ValueError):
        v.new_tbl(spark, [1], name_repair=False)
    with pytest.raises(ValueError):
        v.new_tbl(spark, x=[1, 2], y=3, recycle=False)


@pytest.mark.parametrize("query, values, want", [("dotted_filter", (0.1, 0.2, 0.3), [0.3]), ("filter_grouped", (0.18, 0.73, 0.91), [0.91])])
def test_row_equal_to_its_groups_mean(spark, tmp_path, query, values, want):
    import duckdb

    from verbena.queries import QUERIES, SQL

    # (0.1 + 0.2) + 0.3 > 0.6 = (0.3 + 0.2) + 0.1: the rows arrive in different orders, the sum is that by event_id
    events = [(i, 7, "view", x) for i, x in enumerate(values)]
    for n, order in enumerate((events, events[::-1], [events[2], events[0], events[1]])):
        spark.createDataFrame(order, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        assert [r[-1] for r in rows(QUERIES[query](spark, f"{tmp_path}/{n}"))] == want
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/0/events.parquet/*.parquet'")
    assert [r[-1] for r in con.execute(SQL[query]).fetchall()] == want
