"""Tidy: a lazy DataFrame with groups. Every verb gives a new Tidy; only pull, deframe, group_split and n_groups run jobs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column

from .. import settings
from ..functions import expressions as E
from ..functions.selectors import resolve
from ..plans.order import NUMBER, ROW, Key, by_row, column, listed, number, sort_key, unused, with_row

#: Rows of a stretch of ordered rows without groups, which one task looks at; what stretches hand on is carried over.
STRETCH = 1 << 20


def tidy(x: object, order_by: list | None = None) -> Tidy:
    return x if isinstance(x, Tidy) else Tidy(x, order_by=order_by or [])


class Desc:
    """A sort key, descending; missing values stay last."""

    def __init__(self, key: object) -> None:
        self.key = key


def desc(key: object) -> Desc:
    return Desc(key)


def _list(x: object) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


class Tidy:
    def __init__(self, df: DataFrame, groups: list[str] | None = None, ordered: bool | None = None, order_by: list | None = None, levels: dict | None = None) -> None:
        self.df, self.groups = df, [g for g in groups or [] if g in df.columns]
        self.ordered = settings.get("order_groups") if ordered is None else ordered
        self.order_by, self.levels = order_by or [], levels or {}

    # -- plumbing

    def _new(self, df: DataFrame, groups: list[str] | None = None) -> Tidy:
        return Tidy(df, self.groups if groups is None else groups, self.ordered, [o for o in self.order_by if not isinstance(o, str) or o in df.columns], self.levels)

    def _by(self, by: object) -> list[str]:
        """Temporary grouping; an error on grouped input."""
        if by is None:
            return self.groups
        if self.groups:
            raise ValueError("by= can't be used on grouped data")
        return resolve(self.df.schema, _list(by))

    def _keys(self, order_by: object, df: DataFrame) -> list[Key]:
        out = []
        for o in _list(order_by):
            down = isinstance(o, Desc)
            c = E.build(o.key if down else o, E.Context(df))
            out.append(Key(c, df.select(c.alias("x")).schema[0].dataType, down))
        return out

    def _placed(self, order_by: object = None) -> tuple[DataFrame, list[Key]]:
        """The frame and its row order: given, remembered, or a hidden row number."""
        wanted = _list(order_by) or self.order_by
        if wanted:
            return self.df, self._keys(wanted, self.df)
        df = with_row(self.df)
        return df, by_row()

    def _window(self, groups: list[str], order: list) -> W:
        return W.partitionBy(*listed(groups)).orderBy(*(k.sort if isinstance(k, Key) else k for k in order))

    def _number(self, df: DataFrame, name: str, groups: list[str], order: list) -> DataFrame:
        """Each row's number from 1 in its group; without groups by a sort over all tasks, not a window over everything."""
        if groups:
            return df.withColumn(name, F.row_number().over(self._window(groups, order)))
        return number(df, name, [k.sort if isinstance(k, Key) else k for k in order])

    def _sorted(self, df: DataFrame, keys: list[str], order: bool | None) -> DataFrame:
        flag = self.ordered if order is None else order
        return df.orderBy(*(sort_key(column(k), df.schema[k].dataType) for k in keys)) if flag and keys and not df.isStreaming else df

    def _expand(self, args: tuple, named: dict, groups: list[str], df: DataFrame) -> dict[str, object]:
        out: dict[str, object] = {}
        for a in args:
            if isinstance(a, E.Across):
                out |= a.expressions(E.Context(df, groups))
            elif isinstance(a, str):
                out[a] = a
            else:
                raise TypeError("unnamed expressions must be column names or across()")
        return out | named

    def __getattr__(self, name: str) -> object:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.df, name)

    # -- columns

    def select(self, *columns: object, **renamed: str) -> Tidy:
        """Columns by selector, renamed ones as new=old; missing group keys come first."""
        names = {c: c for c in resolve(self.df.schema, columns)}
        for new, old in renamed.items():
            names[resolve(self.df.schema, [old])[0]] = new
        lacking = [g for g in self.groups if g not in names]
        if lacking:
            settings.inform("adding group keys: %s", lacking)
            names = {g: g for g in lacking} | names
        return self._new(self.df.select(*(column(a).alias(b) for a, b in names.items())), [names[g] for g in self.groups])

    def rename(self, **names: str) -> Tidy:
        back = {resolve(self.df.schema, [old])[0]: new for new, old in names.items()}
        return self._new(self.df.withColumnsRenamed(back), [back.get(g, g) for g in self.groups])

    def pull(self, wanted: object = -1) -> list:
        got = [self.df.columns[-1]] if wanted == -1 else resolve(self.df.schema, _list(wanted))
        if len(got) != 1:
            raise ValueError("pull takes one column")
        return [r[0] for r in self.df.select(column(got[0])).collect()]

    def mutate(self, *args: object, by: object = None, keep: str = "all", order_by: object = None, function: Callable | None = None, schema: str | None = None, **named: object) -> Tidy:
        """New columns, one after the other, each seeing those before it; None removes one. Aggregates go over the group.
        keep: all, none (groups and new), used, unused (new ones and those that no expression names).
        function (with the schema of what it gives): instead, a pandas function of each group's rows that gives as many rows."""
        groups = self._by(by)
        if function is not None:
            return self._new(self.df.groupBy(*listed(groups)).applyInPandas(function, schema))
        df, order = self._placed(order_by) if order_by or self.order_by else (self.df, [])
        start, new, used = list(self.df.columns), [], set()
        for name, x in self._expand(args, named, groups, df).items():
            if x is None:
                df = df.drop(name)
                continue
            c = E.Context(df, groups, order, window=True)
            try:
                made = E.build(x, c)
            except ValueError:
                order = by_row()
                c = E.Context(with_row(df), groups, order, window=True)
                made = E.build(x, c)
            used |= _names(c.df, made) or set()
            df = c.df.withColumn(name, made)
            new.append(name)
        kept = {"all": start, "none": [], "used": [c for c in start if c in used], "unused": [c for c in start if c not in used]}[keep]
        names = list(dict.fromkeys([c for c in start if c in kept or c in groups or c in new] + new))
        return self._new(df.select(*listed([c for c in names if c in df.columns])))

    def filter(self, *tests: object, by: object = None, order_by: object = None) -> Tidy:
        """Rows for which all tests are true; tests may hold aggregates of the group. A row that equals a group's mean, say, is
        decided by the last bits of a sum: an order (order_by) makes reruns agree, as the group's rows then add up in it."""
        groups = self._by(by)
        df, order = self._placed(order_by) if order_by or self.order_by else (self.df, [])
        plain = [t for t in tests if not isinstance(t, E.Expr)]
        grouped = [t for t in tests if isinstance(t, E.Expr)]
        for i, t in enumerate(grouped):  # windows see all rows, so the plain tests come last
            c = E.Context(df, groups, order, window=True)
            made = E.build(t, c)
            df = c.df.withColumn(f"__t{i}", made)
        checks = [F.col(f"__t{i}") for i in range(len(grouped))] + [E.build(t, E.Context(df)) for t in plain]
        return self._new(df.where(reduce(lambda a, b: a & b, checks)).select(*listed(self.df.columns)) if checks else self.df)

    def _missing(self, names: tuple) -> list[Column]:
        c = E.Context(self.df)
        return [c.known(column(x)).isNull() for x in (resolve(self.df.schema, names) if names else self.df.columns)]

    def remove_rows_if_any_na(self, *names: object) -> Tidy:
        return self._new(self.df.where(~reduce(lambda a, b: a | b, self._missing(names), F.lit(False))))

    def remove_rows_if_all_na(self, *names: object) -> Tidy:
        return self._new(self.df.where(~reduce(lambda a, b: a & b, self._missing(names), F.lit(True))))

    def _stretched(self, df: DataFrame, groups: list[str], order: list) -> tuple[DataFrame, list[str], list[Column]]:
        """Where ordered rows are looked at together: their groups or, without groups, stretches of numbered rows."""
        if groups:
            return df, groups, [k.sort for k in order]
        df = number(df, NUMBER, [k.sort for k in order]).withColumn("__stretch", F.floor((F.col(NUMBER) - 1) / STRETCH))
        return df, ["__stretch"], [F.col(NUMBER)]

    def fill(self, *names: object, by: object = None, direction: str = "forwards", limit: float = math.inf, new_names: str = "{col}", order_by: object = None) -> Tidy:
        """Missing values (null, NaN) take the last (direction "backwards": next) known one, at most limit in a row."""
        groups = self._by(by)
        todo = resolve(self.df.schema, names) if names else [c for c in self.df.columns if c not in groups]
        df, order = self._placed(order_by)
        if direction == "backwards":
            order = [k.flip for k in order]
        start = df.columns
        df, parts, sorts = self._stretched(df, groups, order)
        if groups:
            df = df.withColumn(NUMBER, F.row_number().over(W.partitionBy(*listed(parts)).orderBy(*sorts)))
        w = W.partitionBy(*listed(parts)).orderBy(F.col(NUMBER)).rowsBetween(W.unboundedPreceding, 0)
        known = [E.Context(df).known(column(c)) for c in todo]
        found = [F.when(k.isNotNull(), F.struct(F.col(NUMBER).alias("at"), k.alias("x"))) for k in known]
        if not groups:  # the last known value of the stretches before
            ends = df.groupBy("__stretch").agg(*(F.max_by(f, F.when(f.isNotNull(), F.col(NUMBER))).alias(f"__e{i}") for i, f in enumerate(found)))
            before = W.orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
            ends = ends.select("__stretch", *(F.last(f"__e{i}", ignorenulls=True).over(before).alias(f"__e{i}") for i in range(len(todo))))
            df = df.join(ends, "__stretch", "left")
        got = []
        for i, f in enumerate(found):
            last = F.last(f, ignorenulls=True).over(w)
            got.append(last if groups else F.coalesce(last, F.col(f"__e{i}")))
        df = df.withColumns({f"__g{i}": g for i, g in enumerate(got)})
        most = F.lit(True) if limit == math.inf else None
        out = {}
        for i, (c, k) in enumerate(zip(todo, known, strict=True)):
            near = most if most is not None else F.col(NUMBER) - F.col(f"__g{i}.at") <= max(0, int(limit))
            out[new_names.format(col=c)] = F.coalesce(k, F.when(near, F.col(f"__g{i}.x")))
        kept = [column(c) for c in start if c not in out and c != ROW]
        order_of = [c for c in start if c != ROW] + [c for c in out if c not in start]
        return self._new(df.select(*kept, *(v.alias(c) for c, v in out.items())).select(*listed(order_of)))

    # -- groups

    def group_by(self, *columns: object, add: bool = False, order: bool | None = None, levels: dict | None = None, **keys: object) -> Tidy:
        """Keys by selector, or computed (name=expression, over all rows). levels: key -> values that count even without rows."""
        df = self.df
        for k, x in keys.items():
            df = df.withColumn(k, E.build(x, E.Context(df, window=True)))
        named = [*(self.groups if add else []), *resolve(df.schema, columns), *keys]
        flag = settings.get("order_groups") if order is None else order
        return Tidy(df, list(dict.fromkeys(named)), flag, self.order_by, levels)

    def ungroup(self) -> Tidy:
        return Tidy(self.df, [], None, self.order_by)

    def group_vars(self) -> list[str]:
        return list(self.groups)

    def group_ordered(self) -> bool:
        return self.ordered

    def group_keys(self) -> Tidy:
        return Tidy(self._sorted(self.df.select(*listed(self.groups)).distinct(), self.groups, None))

    def group_size(self) -> Tidy:
        return Tidy(self._sorted(self.df.groupBy(*listed(self.groups)).agg(F.count(F.lit(1)).alias("size")), self.groups, None))

    def n_groups(self) -> int:
        return self.df.select(*listed(self.groups)).distinct().count() if self.groups else 1

    def group_data(self) -> Tidy:
        """Keys and the row numbers of each group. The lists hold all rows of a group: for inspection, not for large groups."""
        df = number(self.df, "__i")
        return Tidy(self._sorted(df.groupBy(*listed(self.groups)).agg(F.sort_array(F.collect_list("__i")).alias("rows")), self.groups, None))

    def group_rows(self) -> Tidy:
        return self.group_data().select("rows")

    def group_indices(self) -> Tidy:
        return self.ungroup().add_group_id(*self.groups, name="group_index") if self.groups else self._new(self.df.withColumn("group_index", F.lit(1)))

    def rowwise(self, *columns: object, ascending: bool = True, name: str = ".row_id") -> Tidy:
        out = self.ungroup().add_row_id(*columns, ascending=ascending, name=name)
        return Tidy(out.df, [name], self.ordered, self.order_by)

    def nest_by(self, *names: object, by: object = None, add: bool = False, order: bool | None = None) -> Tidy:
        """A row per group with its other columns as an array of structs; a group must fit into one value. add: beside the groups."""
        own = resolve(self.df.schema, names)
        keys = list(dict.fromkeys([*self.groups, *own])) if add else self._by(by) or own
        rest = [c for c in self.df.columns if c not in keys]
        got = self.df.groupBy(*listed(keys)).agg(F.collect_list(F.struct(*listed(rest))).alias("data"))
        return Tidy(self._sorted(got, keys, order), keys if add else None)

    def group_split(self, names: bool = False, most: int = 1000) -> list | dict:
        """A filtered frame per group; the keys come to the driver, so their number is limited."""
        keys = self.group_keys().df.limit(most + 1).collect()
        if len(keys) > most:
            raise ValueError(f"more than {most} groups")
        parts = {"_".join(str(v) for v in k): self.df.where(reduce(lambda a, b: a & b, [column(c).eqNullSafe(F.lit(k[c])) for c in self.groups])) for k in keys}
        return parts if names else list(parts.values())

    # -- aggregates

    def summarise(self, *args: object, by: object = None, order: bool | None = None, order_by: object = None, **named: object) -> Tidy:
        """A row per group, ungrouped; expressions may name results before them. Levels given to group_by all appear."""
        groups = self._by(by)
        order_cols = _list(order_by) or self.order_by
        c = E.Context(self.df, groups, self._keys(order_cols, self.df))
        aggregates, later, numbered = {}, {}, []
        for k, x in self._expand(args, named, groups, self.df).items():
            if isinstance(x, E.GroupId):
                numbered.append(k)
            elif isinstance(x, Column) and aggregates and _names(self.df, x) is None:
                later[k] = x
            else:
                aggregates[k] = E.build(x, c)
        cols = [v.alias(k) for k, v in aggregates.items()] or [F.count(F.lit(1)).alias("__n")]
        got = c.df.groupBy(*listed(groups)).agg(*cols).drop("__n")
        for k in numbered:
            got = number(got, k, [sort_key(column(g), got.schema[g].dataType) for g in groups])
        for k, x in later.items():
            got = got.withColumn(k, x)
        if self.levels:
            base = None
            for g in groups:
                own = self.df.sparkSession.createDataFrame([(v,) for v in self.levels[g]], T.StructType([got.schema[g]])) if g in self.levels else self.df.select(column(g)).distinct()
                base = own if base is None else base.crossJoin(own)
            got = Tidy(base).left_join(Tidy(got), by=groups).df
        return Tidy(self._sorted(got, groups, order))

    summarize = summarise

    def reframe(self, *args: object, by: object = None, order: bool | None = None, function: Callable | None = None, schema: str | None = None, **named: object) -> Tidy:
        """Any number of rows per group: expressions that give an array become its rows (shorter ones repeat); or a pandas
        function with its schema, group by group."""
        groups = self._by(by)
        if function is not None:
            return Tidy(self._sorted(self.df.groupBy(*listed(groups)).applyInPandas(function, schema), groups, order))
        c = E.Context(self.df, groups)
        made = {k: E.build(x, c) for k, x in self._expand(args, named, groups, self.df).items()}
        got = c.df.groupBy(*listed(groups)).agg(*(v.alias(k) for k, v in made.items()))
        arrays = {k: column(k) if isinstance(got.schema[k].dataType, T.ArrayType) else F.array(column(k)) for k in made}
        size = F.greatest(*(F.size(a) for a in arrays.values())) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
        got = got.withColumn("__i", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))))
        got = got.select(*listed(groups), *(F.element_at(a, (F.col("__i") % F.size(a) + 1).cast("int")).alias(k) for k, a in arrays.items()))
        return Tidy(self._sorted(got, groups, order))

    def _count_keys(self, columns: tuple, by: object, computed: dict) -> tuple[DataFrame, list[str]]:
        df = self.df
        for k, x in computed.items():
            df = df.withColumn(k, E.build(x, E.Context(df, self.groups, window=True)))
        return df, list(dict.fromkeys([*self._by(by), *resolve(df.schema, columns), *computed]))

    def count(self, *columns: object, wt: object = None, sort: bool = False, order: bool | None = None, name: str | None = None, by: object = None, **computed: object) -> Tidy:
        """Rows, or the sum of known weights, per combination; the column is n, or nn ... if that is a key."""
        df, keys = self._count_keys(columns, by, computed)
        name = name or unused("n", keys)
        got = df.groupBy(*listed(keys)).agg(self._size(df, wt).alias(name))
        kept = [g for g in self.groups if set(self.groups) != set(keys)]
        return Tidy(got.orderBy(column(name).desc(), *(sort_key(column(k), got.schema[k].dataType) for k in keys)) if sort else self._sorted(got, keys, order), kept)

    def _size(self, df: DataFrame, wt: object) -> Column:
        c = E.Context(df)
        return F.count(F.lit(1)) if wt is None else F.coalesce(F.sum(c.known(E.build(wt, c)).cast("double")), F.lit(0.0))

    def add_count(self, *columns: object, wt: object = None, sort: bool = False, name: str | None = None, by: object = None, **computed: object) -> Tidy:
        df, keys = self._count_keys(columns, by, computed)
        name = name or unused("n", df.columns)
        size = F.count(F.lit(1)) if wt is None else F.sum(E.Context(df).known(E.build(wt, E.Context(df))).cast("double"))
        size = E.Context(df, keys, window=True).over(size)
        df = df.withColumn(name, size if wt is None else F.coalesce(size, F.lit(0.0)))
        return self._new(df.orderBy(column(name).desc()) if sort else df)

    def distinct(self, *columns: object, keep_all: bool = False, order: bool = False, by: object = None, order_by: object = None) -> Tidy:
        keys = list(dict.fromkeys([*self._by(by), *resolve(self.df.schema, columns)])) if columns or by or self.groups else list(self.df.columns)
        keys = keys if columns or keep_all or not (by or self.groups) else list(self.df.columns)
        if not keep_all:
            return self._new(self._sorted(self.df.select(*listed(keys)).distinct(), keys, order))
        df, place = self._placed(order_by)
        df = df.withColumn("__rn", F.row_number().over(self._window(keys, place))).where("__rn = 1").drop("__rn", ROW)
        return self._new(self._sorted(df, keys, order))

    def duplicates(self, *columns: object, keep_all: bool = False, both_ways: bool = False, add_count: bool = False, drop_empty: bool = False, order: bool = False, by: object = None, order_by: object = None) -> Tidy:
        """Second and further occurrences, or (both_ways) all members of groups with several; drop_empty leaves out rows whose
        keys are all missing."""
        extra = self._by(by)
        cols = resolve(self.df.schema, columns) if columns else [c for c in self.df.columns if c not in extra]
        keys = list(dict.fromkeys([*extra, *cols]))
        df, place = self._placed(order_by)
        df = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*listed(keys))))
        if both_ways:
            df = df.where("__n > 1")
        else:
            df = df.withColumn("__rn", F.row_number().over(self._window(keys, place))).where("__rn > 1").drop("__rn")
        if drop_empty:
            df = df.where(~reduce(lambda a, b: a & b, [E.Context(df).known(column(c)).isNull() for c in cols], F.lit(True)))
        out = self.df.columns if keep_all or not columns else keys
        name = unused("n", out)
        if add_count:
            df = df.withColumn(name, F.col("__n") if both_ways else F.greatest(F.col("__n") - 1, F.lit(1)))
        return self._new(self._sorted(df.select(*listed(out), *listed([name] if add_count else [])), keys, order))

    def quantiles(self, *columns: object, probs: tuple = (0, 0.25, 0.5, 0.75, 1), type: int = 7, pivot: str = "long", na_rm: bool = True, by: object = None, order: bool | None = None) -> Tidy:
        """Exact sample quantiles of types 5 to 9, a column per probability (wide) or a row (long)."""
        groups = self._by(by)
        cols = resolve(self.df.schema, columns)
        label = ["p" + f"{100 * p:.10g}" for p in probs]
        df, c = self.df, E.Context(self.df)
        aggs = []
        for x in cols:
            v = c.known(column(x)).cast("double")
            clean = F.lit(True) if na_rm else F.count(F.lit(1)) == F.count(v)
            if type == 7:
                got = F.percentile(v, F.array(*(F.lit(float(p)) for p in probs))) if probs else F.array().cast("array<double>")
                parts = [got[i] for i in range(len(probs))]
            else:
                k = len(df.columns)
                df = df.withColumn(f"__n{k}", E.Context(df, groups, window=True).over(F.count(v)))
                df = self._number(df, f"__r{k}", groups, [v.asc_nulls_last()])
                parts = [F.sum(F.when(v.isNotNull(), v * _weight(F.col(f"__r{k}"), F.col(f"__n{k}"), float(p), type))) for p in probs]
            aggs += [F.when(clean, part).alias(f"{x}\t{i}") for i, part in enumerate(parts)]
        got = df.groupBy(*listed(groups)).agg(*aggs) if aggs else df.select(*listed(groups)).distinct()
        if pivot == "wide":
            names = {f"{x}\t{i}": (f"{x}_" if len(cols) > 1 else "") + label[i] for x in cols for i in range(len(probs))}
            return Tidy(self._sorted(got.withColumnsRenamed(names), groups, order))
        rows = F.array(*(F.struct(F.lit(label[i]).alias(".quantile"), *(column(f"{x}\t{i}").alias(x) for x in cols)) for i in range(len(probs))))
        got = got.select(*listed(groups), F.explode(rows).alias("q")).select(*listed(groups), "q.*") if probs else got.select(*listed(groups), F.lit("").alias(".quantile"), *(F.lit(None).cast("double").alias(x) for x in cols)).limit(0)
        return Tidy(self._sorted(got, groups, order))

    # -- joins

    def _join(self, y: object, how: str, by: object, suffix: tuple[str, str] = (".x", ".y"), multiple: bool = True, keep: bool = False, order_by: object = None, broadcast: bool = False) -> Tidy:
        right = tidy(y)
        x_df, y_df = self.df, right.df
        if by is None:
            pairs = [(c, c) for c in x_df.columns if c in y_df.columns]
            if not pairs:
                raise ValueError("no common columns to join by")
            settings.inform("joining by %s", [p[0] for p in pairs])
        elif isinstance(by, dict):
            pairs = list(by.items())
        else:
            pairs = [p if isinstance(p, tuple) else (p, p) for p in _list(by)]
        for a, b in pairs:
            if a not in x_df.columns or b not in y_df.columns:
                raise KeyError(f"no such join column: {a}, {b}")
        lk, rk = [p[0] for p in pairs], [p[1] for p in pairs]
        if not multiple and how not in ("left_semi", "left_anti"):
            placed, order = right._placed(order_by)
            y_df = placed.withColumn("__rn", F.row_number().over(W.partitionBy(*listed(rk)).orderBy(*(k.sort for k in order)))).where("__rn = 1").drop("__rn", ROW)
        x_free = x_df.columns if keep else [c for c in x_df.columns if c not in lk]
        y_free = y_df.columns if keep else [c for c in y_df.columns if c not in rk]
        xs = {c: c for c in x_df.columns}
        ys = {c: c for c in y_df.columns}
        if how not in ("left_semi", "left_anti"):
            for c in [c for c in x_free if c in set(y_free)]:
                xs[c] = _suffixed(c, suffix[0], x_df.columns)
            for c in [c for c in y_free if c in set(x_df.columns) and (keep or c not in rk)]:
                ys[c] = _suffixed(c, suffix[1], [*y_df.columns, *(xs[k] for k in x_df.columns if xs[k] == k and c != k)])
        x_df = x_df.select(*(column(c).alias(f"__x_{c}") for c in x_df.columns))
        y_df = y_df.select(*(column(c).alias(f"__y_{c}") for c in y_df.columns))
        on = reduce(lambda a, b: a & b, [_key(x_df, f"__x_{a}").eqNullSafe(_key(y_df, f"__y_{b}")) for a, b in pairs])
        got = x_df.join(F.broadcast(y_df) if broadcast else y_df, on, how)
        left = {c: column(f"__x_{c}") for c in xs}
        if how in ("right", "full") and not keep:
            for a, b in pairs:
                left[a] = F.coalesce(column(f"__x_{a}"), column(f"__y_{b}"))
        out = [v.alias(xs[c]) for c, v in left.items()]
        if how not in ("left_semi", "left_anti"):
            out += [column(f"__y_{c}").alias(ys[c]) for c in y_free]
        return self._new(got.select(*out), [xs[g] for g in self.groups])

    def left_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "left", by, **kw)

    def right_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "right", by, **kw)

    def inner_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "inner", by, **kw)

    def full_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "full", by, **kw)

    def semi_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "left_semi", by, **kw)

    def anti_join(self, y: object, by: object = None, **kw: object) -> Tidy:
        return self._join(y, "left_anti", by, **kw)

    def cross_join(self, y: object, suffix: tuple[str, str] = (".x", ".y")) -> Tidy:
        b = tidy(y).df
        clash = set(self.df.columns) & set(b.columns)
        left = self.df.select(*(column(c).alias(c + suffix[0] if c in clash else c) for c in self.df.columns))
        return Tidy(left.crossJoin(b.select(*(column(c).alias(c + suffix[1] if c in clash else c) for c in b.columns))))

    # -- identifiers

    def add_group_id(self, *columns: object, by: object = None, order: bool | None = None, ascending: bool = True, name: str | None = None, order_by: object = None) -> Tidy:
        """A number from 1 for each combination of keys, sorted or by first appearance. Numbers are given to the distinct keys
        and joined back, so no task sees all rows."""
        keys = list(dict.fromkeys([*self._by(by), *resolve(self.df.schema, columns)])) or list(self.df.columns)
        name = name or unused("group_id", self.df.columns, "")
        flag = self.ordered if order is None else order
        df = self.df
        if flag:
            ids = number(df.select(*listed(keys)).distinct(), name, [sort_key(column(k), df.schema[k].dataType, not ascending) for k in keys])
        else:
            placed = self._placed(order_by)[0]
            at = F.min(F.struct(*listed(_list(order_by) or self.order_by or [ROW])))
            ids = number(placed.groupBy(*listed(keys)).agg(at.alias("__at")), name, [F.col("__at").asc() if ascending else F.col("__at").desc()]).drop("__at")
        return self._new(Tidy(df)._join(ids, "left", keys).df)

    def add_row_id(self, *columns: object, by: object = None, ascending: bool = True, name: str | None = None, order_by: object = None) -> Tidy:
        keys = list(dict.fromkeys([*self._by(by), *resolve(self.df.schema, columns)]))
        name = name or unused("row_id", self.df.columns, "")
        if not keys:
            order = self._keys(_list(order_by) or self.order_by, self.df)
            return self._new(number(self.df, name, [(k if ascending else k.flip).sort for k in order] or (None if ascending else [F.monotonically_increasing_id().desc()])))
        df, order = self._placed(order_by)
        order = order if ascending else [k.flip for k in order]
        return self._new(df.withColumn(name, F.row_number().over(self._window(keys, order)).cast("long")).drop(ROW))

    def add_consecutive_id(self, *columns: object, by: object = None, name: str | None = None, order_by: object = None) -> Tidy:
        """A number of each run of equal values, in row order, within groups."""
        groups = self._by(by)
        cols = resolve(self.df.schema, columns)
        name = name or unused("consecutive_id", self.df.columns, "")
        if not cols:
            return self._new(self.df.withColumn(name, F.lit(1).cast("long")))
        df, order = self._placed(order_by)
        start = [c for c in df.columns if c != ROW]
        values = F.struct(*(E.Context(df).known(column(x)) for x in cols))
        if groups:
            w = self._window(groups, order)
            change = F.when((F.row_number().over(w) == 1) | ~values.eqNullSafe(F.lag(values).over(w)), 1).otherwise(0)
            return self._new(df.withColumn("__c", change).withColumn(name, F.sum("__c").over(w).cast("long")).drop("__c", ROW))
        # runs within stretches, a stretch's first row compared with the last of the one before
        df, parts, sorts = self._stretched(df, [], order)
        df = df.withColumn("__v", values)
        w = W.partitionBy("__stretch").orderBy(*sorts)
        df = df.withColumn("__c", F.when(F.row_number().over(w) == 1, 0).when(~F.col("__v").eqNullSafe(F.lag("__v").over(w)), 1).otherwise(0))
        ends = df.groupBy("__stretch").agg(F.sum("__c").alias("s"), F.min_by("__v", NUMBER).alias("a"), F.max_by("__v", NUMBER).alias("z"))
        along = W.orderBy("__stretch")  # one row for each stretch
        ends = ends.withColumn("new", F.when((F.row_number().over(along) == 1) | ~F.col("a").eqNullSafe(F.lag("z").over(along)), 1).otherwise(0))
        ends = ends.select("__stretch", (F.sum(F.col("s") + F.col("new")).over(along) - F.col("s")).alias("__base"))
        df = df.join(ends, "__stretch").withColumn(name, (F.col("__base") + F.sum("__c").over(w)).cast("long"))
        return self._new(df.select(*listed([c for c in start if c != name]), column(name)))

    # -- order and slices

    def arrange(self, *keys: object, by_group: bool = False, descending: bool = False) -> Tidy:
        """Sorted rows, missing values last; no keys: as it is. Ties keep the row order."""
        wanted = [*(self.groups if by_group else []), *(desc(k) if descending and not isinstance(k, Desc) else k for k in keys)]
        if not wanted:
            return self
        df = with_row(self.df)
        out = df.orderBy(*(k.sort for k in self._keys(wanted, df)), F.col(ROW)).drop(ROW)
        return Tidy(out, self.groups, self.ordered, [*wanted, *self.order_by], self.levels)

    def _finish(self, df: DataFrame, order: list[Key], keep_order: bool) -> Tidy:
        if keep_order:
            df = df.orderBy(*(k.sort for k in order))
        return self._new(df.select(*listed(self.df.columns)))

    def slice(self, *places: int, by: object = None, keep_order: bool = False, order_by: object = None) -> Tidy:
        """Rows at these places (from 1) of each group, repeats repeated; negative ones: all others; out of range: none."""
        wanted = [int(i) for p in places for i in (p if isinstance(p, (list, tuple, range)) else [p]) if int(i) != 0]
        if any(i < 0 for i in wanted) and any(i > 0 for i in wanted):
            raise ValueError("places must be all positive or all negative")
        df, order = self._placed(order_by)
        df = self._number(df, "__rn", self._by(by), order)
        if wanted and wanted[0] < 0:
            return self._finish(df.where(~F.col("__rn").isin([-i for i in wanted])), order, keep_order)
        df = df.where(F.col("__rn").isin(wanted or [0]))
        times = F.array_compact(F.array(*(F.when(F.col("__rn") == i, F.lit(k)) for k, i in enumerate(wanted)))) if wanted else F.array(F.lit(0))
        return self._finish(df.withColumn("__k", F.explode(times)), order, keep_order)

    def _many(self, n: int | None, prop: float | None, default: object, size: Column) -> Column:
        if n is not None and prop is not None:
            raise ValueError("give n or prop, not both")
        if prop is not None:
            return F.greatest(F.floor(F.lit(float(prop)) * size) if prop >= 0 else F.ceil(F.lit(1.0 + prop) * size), F.lit(0))
        n = default if n is None else n
        if n is None:
            return size
        return F.lit(n) if n >= 0 else F.greatest(size + n, F.lit(0))

    def _ranked(self, df: DataFrame, groups: list[str], order: list, n: int | None, prop: float | None, default: object) -> DataFrame:
        """The first rows of each group in the order."""
        n = default if n is None and prop is None else n
        simple = prop is None and n is not None and n >= 0
        if simple and not groups:
            return df.orderBy(*(k.sort if isinstance(k, Key) else k for k in order)).limit(n)
        df = self._number(df, "__rn", groups, order)
        if not simple:
            df = df.withColumn("__size", E.Context(df, groups, window=True).over(F.count(F.lit(1))))
        return df.where(F.col("__rn") <= self._many(n, prop, default, F.col("__size")))

    def slice_head(self, n: int | None = None, prop: float | None = None, by: object = None, keep_order: bool = False, order_by: object = None) -> Tidy:
        df, order = self._placed(order_by)
        return self._finish(self._ranked(df, self._by(by), order, n, prop, 1), order, keep_order)

    def slice_tail(self, n: int | None = None, prop: float | None = None, by: object = None, keep_order: bool = False, order_by: object = None) -> Tidy:
        df, order = self._placed(order_by)
        return self._finish(self._ranked(df, self._by(by), [k.flip for k in order], n, prop, 1), order, keep_order)

    def _slice_best(self, value: object, down: bool, n: int | None, prop: float | None, by: object, with_ties: bool, na_rm: bool, keep_order: bool, order_by: object) -> Tidy:
        groups = self._by(by)
        df, order = self._placed(order_by) if keep_order or not with_ties else (self.df, [])
        c = E.Context(df, groups, order, window=True)
        made = c.known(E.build(value, c))
        df = c.df.withColumn("__v", made)
        first = F.col("__v").desc_nulls_last() if down else F.col("__v").asc_nulls_last()
        if not with_ties:
            df = self._ranked(df, groups, [first, *order], n, prop, 1)
        elif groups:
            simple = prop is None and (n is None or n >= 0)
            df = df.withColumn("__rn", F.rank().over(self._window(groups, [first])))
            df = df if simple else df.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy(*listed(groups))))
            df = df.where(F.col("__rn") <= self._many(n, prop, 1, F.col("__size")))
        else:  # all rows up to the last chosen value; a missing one comes last, so it takes all
            top = self._ranked(df.select("__v"), [], [first], n, prop, 1).agg(F.count(F.lit(1)).alias("k"), F.count("__v").alias("known"), (F.min if down else F.max)("__v").alias("edge"))
            k, known, edge = (top.select(x).scalar() for x in ("k", "known", "edge"))
            df = df.where((k > 0) & ((known < k) | F.coalesce(F.col("__v") >= edge if down else F.col("__v") <= edge, F.lit(False))))
        return self._finish(df.where("__v is not null") if na_rm else df, order, keep_order)

    def slice_min(self, value: object, n: int | None = None, prop: float | None = None, by: object = None, with_ties: bool = True, na_rm: bool = False, keep_order: bool = False, order_by: object = None) -> Tidy:
        return self._slice_best(value, False, n, prop, by, with_ties, na_rm, keep_order, order_by)

    def slice_max(self, value: object, n: int | None = None, prop: float | None = None, by: object = None, with_ties: bool = True, na_rm: bool = False, keep_order: bool = False, order_by: object = None) -> Tidy:
        return self._slice_best(value, True, n, prop, by, with_ties, na_rm, keep_order, order_by)

    def slice_sample(self, n: int | None = None, prop: float | None = None, by: object = None, replace: bool = False, weights: str | None = None, seed: int = 0, keep_order: bool = False, order_by: object = None) -> Tidy:
        """Random rows of each group (default: all, shuffled), without replacement by random keys (exponential ones for
        weights), with replacement by drawn places."""
        groups = self._by(by)
        df, order = self._placed(order_by)
        if not replace:
            key = F.rand(seed) if weights is None else -F.log(F.rand(seed)) / F.nullif(column(weights), F.lit(0))
            df = df.withColumn("__key", key)
            return self._finish(self._ranked(df, groups, [F.col("__key").asc_nulls_last()], n, prop, None), order, keep_order)
        df = df.withColumn("__size", E.Context(df, groups, window=True).over(F.count(F.lit(1))))
        df = self._number(df, "__rn", groups, order)
        draws = df.where("__rn = 1").select(*listed(groups), "__size", F.explode(F.sequence(F.lit(1), self._many(n, prop, None, F.col("__size")).cast("int"))).alias("__draw"))
        draws = draws.select(*listed(groups), (F.floor(F.rand(seed) * F.col("__size")) + 1).cast("long").alias("__rn"))
        return self._finish(Tidy(df)._join(draws, "inner", [*groups, "__rn"]).df, order, keep_order)

    # -- rows and columns together

    def union_all(self, *others: object) -> Tidy:
        return bind_rows(self, *others)

    def union(self, *others: object) -> Tidy:
        return self._new(bind_rows(self, *others).df.distinct())

    def expand(self, *args: object, by: object = None, sort: bool = False, **values: object) -> Tidy:
        """All combinations of the distinct values of each argument (columns, value lists, frames), within groups."""
        groups = self._by(by)
        parts = [self.df.select(*listed(groups), column(c)).distinct() for c in resolve(self.df.schema, [a for a in args if not isinstance(a, (Tidy, DataFrame))])]
        parts += [tidy(a).df.distinct() for a in args if isinstance(a, (Tidy, DataFrame))]
        for k, v in values.items():
            if isinstance(v, (E.Expr, Column)):
                parts.append(self.df.select(*listed(groups), E.build(v, E.Context(self.df)).alias(k)).distinct())
            else:
                kind = self.df.schema[k].dataType if k in self.df.columns else None
                one = self.df.sparkSession.range(1).select(F.array(*map(F.lit, v)).alias("v")).select(F.explode(F.array_distinct("v")).alias(k))
                parts.append(one.select(column(k).cast(kind).alias(k)) if kind else one)
        out = self.df.select(*listed(groups)).distinct() if groups else None
        for p in parts:
            out = p if out is None else Tidy(out)._join(p, "inner", groups).df if groups and set(groups) <= set(p.columns) else out.crossJoin(p)
        if out is None:
            out = self.df.sparkSession.range(1).select()
        return Tidy(self._sorted(out, out.columns, sort), self.groups)

    def complete(self, *args: object, by: object = None, sort: bool = False, fill: dict | None = None, **values: object) -> Tidy:
        """The rows and, for each combination that has none, a row of missing values; fill replaces all missing ones."""
        grid = self.expand(*args, by=by, **values).df
        more = Tidy(grid)._join(self.df.select(*listed(grid.columns)), "left_anti", list(grid.columns)).df
        df = self.df.unionByName(more, allowMissingColumns=True).select(*listed(self.df.columns))
        for k, v in (fill or {}).items():
            df = df.withColumn(k, F.coalesce(E.Context(df).known(column(k)), F.lit(v).cast(df.schema[k].dataType)))
        return self._new(self._sorted(df, grid.columns, sort))


def _names(df: DataFrame, c: Column) -> set[str] | None:
    """The frame's columns that an expression names; None if it names others."""
    try:
        refs = df.select(c.alias("x"))._jdf.queryExecution().analyzed().references().iterator()
    except Exception:  # unresolved against this frame
        return None
    out = set()
    while refs.hasNext():
        out.add(refs.next().name())
    return out & set(df.columns)


def _key(df: DataFrame, name: str) -> Column:
    """A join key; maps, which Spark doesn't compare, as their sorted entries."""
    return F.sort_array(F.map_entries(column(name))) if isinstance(df.schema[name].dataType, T.MapType) else column(name)


def _suffixed(name: str, suffix: str, taken: list[str]) -> str:
    out = name
    while suffix and (out == name or out in taken):
        out += suffix
    return out


def _weight(rank: Column, n: Column, p: float, kind: int) -> Column:
    """What the value of this rank counts in the quantile: its place h lies between two ranks."""
    a, b = {5: (0.5, 0.5), 6: (0.0, 0.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
    h = F.least(F.greatest(F.lit(a) + F.lit(p) * (n + 1 - a - b), F.lit(1.0)), n.cast("double"))
    low = F.floor(h)
    return F.when(rank == low, 1 - (h - low)).when(rank == low + 1, h - low).otherwise(0.0)


def bind_rows(*frames: object) -> Tidy:
    """Rows of all frames, columns by name; missing columns are null."""
    flat = [x for f in frames for x in (f if isinstance(f, (list, tuple)) else [f]) if x is not None]
    first = tidy(flat[0])
    return first._new(reduce(lambda a, b: a.unionByName(tidy(b).df, allowMissingColumns=True), flat[1:], first.df))


def bind_cols(*frames: object, repair_names: bool = True, recycle: bool = True, **values: object) -> Tidy:
    """Columns side by side, row by row. Lists and single values (by name) are columns too; with recycle a frame or list of one
    row repeats. Otherwise all must have as many rows, or an error is raised as the result is read."""
    parts = [tidy(f).df for f in frames if f is not None]
    spark = parts[0].sparkSession if parts else SparkSession.active()
    for k, v in values.items():
        parts.append(spark.createDataFrame([(x,) for x in (v if isinstance(v, (list, tuple, range)) else [v])], [k]))
    taken: list[str] = []
    numbered, ones = [], []
    for p in parts:
        names = []
        for c in p.columns:
            names.append(unused(c, taken + names, "_1") if repair_names else c)
        taken += names
        p = p.toDF(*names)
        # a second row is looked for, not all rows counted
        (ones if recycle and len(parts) > 1 and len(p.take(2)) == 1 else numbered).append(p)
    if not numbered:
        numbered, ones = ones[:1], ones[1:]
    out = None
    for i, p in enumerate(number(p, NUMBER) for p in numbered):
        if out is None:
            out = p.withColumn("__l", F.lit(True))
            continue
        out = out.join(p.withColumn("__r", F.lit(True)), NUMBER, "full")
        whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
        out = out.withColumn("__l", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("bind_cols: frames differ in their number of rows")).cast("boolean"))).where("__l").drop("__r")
    for p in ones:
        out = out.crossJoin(F.broadcast(p))  # of one row
    return Tidy(out.orderBy(NUMBER).select(*listed(taken)))
