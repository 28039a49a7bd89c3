"""Expressions that know their groups: the same ``mean("x")`` is an aggregate in summarise and a window in mutate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..plans.order import NUMBER, column, listed, null_safe, number, sort_key
from .selectors import resolve


@dataclass
class Context:
    """What an expression is built against: window: aggregates go over the group's rows; else they aggregate.

    An expression may add hidden columns to df (names begin with two underscores), so df counts after building.
    """

    df: DataFrame
    groups: list[str] = field(default_factory=list)
    order: list = field(default_factory=list)
    window: bool = False

    def kind(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("x")).schema[0].dataType

    def known(self, column: Column) -> Column:
        """NaN counts as missing."""
        return F.nullif(column, F.lit(float("nan"))) if isinstance(self.kind(column), (T.DoubleType, T.FloatType)) else column

    def by(self) -> W:
        return W.partitionBy(*listed(self.groups))

    def over(self, aggregate: Column, adds: bool = False) -> Column:
        """Without groups a scalar subquery: a window over everything would take all rows to one task.

        adds: it adds up values, and the last bits of a sum of doubles depend on the order of the rows, which a shuffle leaves
        open. So a group's rows add up in the order, if there is one (with ties the order of tied rows stays open)."""
        if not self.window:
            return aggregate
        if not self.groups:
            return self.df.agg(aggregate.alias("x")).scalar()
        rows = self.ordered().rowsBetween(W.unboundedPreceding, W.unboundedFollowing) if adds and self.order else self.by()
        return aggregate.over(rows)

    def ordered(self) -> W:
        self.needs_order()
        return self.by().orderBy(*(k.sort for k in self.order))

    def needs_order(self) -> None:
        if not self.order:
            raise ValueError("this expression depends on row order: give order_by")

    def hidden(self, column: Column) -> Column:
        name = f"__h{len(self.df.columns)}"
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    def place(self) -> Column:
        """Each row's number, from 1, in the order: of its group or, distributed, of all rows."""
        if self.groups:
            return self.hidden(F.row_number().over(self.ordered()))
        self.needs_order()
        if NUMBER not in self.df.columns:
            self.df = number(self.df, NUMBER, [k.sort for k in self.order])
        return F.col(NUMBER)

    def moved(self, value: Column, n: int, default: object) -> Column:
        """The value n rows before (after, if negative). Without groups, by a join of row numbers."""
        if self.groups:
            return (F.lag(value, n, default) if n >= 0 else F.lead(value, -n, default)).over(self.ordered())
        at = self.place()
        name, there = f"__h{len(self.df.columns)}", f"__f{len(self.df.columns)}"
        other = self.df.select((at + n).alias(NUMBER), value.alias(name), F.lit(True).alias(there))
        self.df = self.df.join(other, NUMBER, "left")
        return F.col(name) if default is None else F.when(F.col(there), F.col(name)).otherwise(F.lit(default))


class Expr:
    def __init__(self, build: Callable[[Context], Column]) -> None:
        self.build = build

    def _with(self, other: object, f: Callable[[Column, Column], Column]) -> Expr:
        return Expr(lambda c: f(self.build(c), build(other, c)))

    def __add__(self, o): return self._with(o, lambda a, b: a + b)
    def __radd__(self, o): return self._with(o, lambda a, b: b + a)
    def __sub__(self, o): return self._with(o, lambda a, b: a - b)
    def __rsub__(self, o): return self._with(o, lambda a, b: b - a)
    def __mul__(self, o): return self._with(o, lambda a, b: a * b)
    def __rmul__(self, o): return self._with(o, lambda a, b: b * a)
    def __truediv__(self, o): return self._with(o, lambda a, b: a / b)
    def __rtruediv__(self, o): return self._with(o, lambda a, b: b / a)
    def __gt__(self, o): return self._with(o, lambda a, b: a > b)
    def __ge__(self, o): return self._with(o, lambda a, b: a >= b)
    def __lt__(self, o): return self._with(o, lambda a, b: a < b)
    def __le__(self, o): return self._with(o, lambda a, b: a <= b)
    def __eq__(self, o): return self._with(o, lambda a, b: a == b)
    def __ne__(self, o): return self._with(o, lambda a, b: a != b)
    def __and__(self, o): return self._with(o, lambda a, b: a & b)
    def __or__(self, o): return self._with(o, lambda a, b: a | b)
    def __invert__(self): return Expr(lambda c: ~self.build(c))
    def __neg__(self): return Expr(lambda c: -self.build(c))
    __hash__ = object.__hash__

    def pipe(self, f: Callable[[Column], Column]) -> Expr:
        """Any column function of the value."""
        return Expr(lambda c: f(self.build(c)))


def build(x: object, c: Context) -> Column:
    """A string is a column's name; other plain values are literals."""
    if isinstance(x, Expr):
        return x.build(c)
    if isinstance(x, Column):
        return x
    return column(x) if isinstance(x, str) else F.lit(x)


def col(name: str) -> Expr:
    return Expr(lambda c: column(name))


def group_function(f: Callable, kind: str, *values: object) -> Expr:
    """A Python function of a group's values (pandas series) that gives one value: an aggregate in summarise, repeated for all
    rows in mutate. A group has to fit into a worker's memory."""

    def go(c: Context) -> Column:
        return c.over(F.pandas_udf(lambda *x: f(*x), kind, F.PandasUDFType.GROUPED_AGG)(*(build(v, c) for v in values)))

    return Expr(go)


def _aggregate(f: Callable[[Column], Column], plain: str, adds: bool = False) -> Callable[..., Expr]:
    def made(x: object, na_rm: bool = True) -> Expr:
        """Missing values (null, NaN) are skipped; with na_rm=False one of them makes the result null. With optimisations
        switched off the same runs in pandas, group by group."""

        def go(c: Context) -> Column:
            v = c.known(build(x, c))
            if settings.get("optimise"):
                got = c.over(f(v), adds)
            else:
                kind = c.kind(f(v))
                got = group_function(lambda s: _plain(s, plain), kind, v).build(c)
            return got if na_rm else F.when(c.over(F.count(F.lit(1))) == c.over(F.count(v)), got)

        return Expr(go)

    return made


def _plain(s, name: str):
    s = s.dropna()
    few = 1 if name in ("std", "var") else 0
    return getattr(s, name)() if len(s) > few else None


sum = _aggregate(F.sum, "sum", adds=True)
prod = _aggregate(F.product, "prod", adds=True)
mean = _aggregate(F.avg, "mean", adds=True)
median = _aggregate(F.median, "median")
min = _aggregate(F.min, "min")
max = _aggregate(F.max, "max")
sd = _aggregate(F.stddev_samp, "std", adds=True)
var = _aggregate(F.var_samp, "var", adds=True)


def n_distinct(x: object) -> Expr:
    def go(c: Context) -> Column:
        v = c.known(build(x, c))
        if not (c.window and c.groups):
            return c.over(F.count_distinct(v))
        # the largest dense rank: sorts, which may spill, instead of a set that holds a whole group
        rank = c.hidden(F.when(v.isNotNull(), F.dense_rank().over(c.by().orderBy(v.asc_nulls_last()))))
        return F.coalesce(F.max(rank).over(c.by()), F.lit(0)).cast("long")

    return Expr(go)


def n() -> Expr:
    return Expr(lambda c: c.over(F.count(F.lit(1))))


def _end(last: bool) -> Callable[..., Expr]:
    def made(x: object, order_by: object = None) -> Expr:
        """The first (last) value that isn't missing, by row order."""

        def go(c: Context) -> Column:
            v = c.known(build(x, c))
            if order_by is not None:
                keys = [build(order_by, c)]
            else:
                c.needs_order()
                keys = [c.place()] if any(k.down for k in c.order) else [k.value for k in c.order]
            place = F.when(v.isNotNull(), F.struct(*keys))
            return c.over((F.max_by if last else F.min_by)(v, place))

        return Expr(go)

    return made


first, last = _end(False), _end(True)


def row_number() -> Expr:
    return Expr(lambda c: c.place())


def lag(x: object, n: int = 1, default: object = None) -> Expr:
    return Expr(lambda c: c.moved(build(x, c), n, default))


def lead(x: object, n: int = 1, default: object = None) -> Expr:
    return Expr(lambda c: c.moved(build(x, c), -n, default))


def cur_group() -> Expr:
    return Expr(lambda c: F.struct(*listed(c.groups)))


class GroupId(Expr):
    """The group's number, by sorted keys; 1 without groups. In mutate the numbered keys are joined to the rows."""

    def __init__(self) -> None:
        super().__init__(self._rows)

    @staticmethod
    def _rows(c: Context) -> Column:
        if not c.groups:
            return F.lit(1).cast("long")
        name = f"__h{len(c.df.columns)}"
        keys = c.df.select(*listed(c.groups)).distinct()
        c.df = null_safe(c.df, number(keys, name, [sort_key(column(g), c.df.schema[g].dataType) for g in c.groups]), c.groups)
        return F.col(name)


def cur_group_id() -> Expr:
    return GroupId()


def cur_group_rows() -> Expr:
    """Row numbers in the frame, from 1: each row's in mutate, a sorted list of a group's in summarise (which has to fit into a value)."""

    def go(c: Context) -> Column:
        name = f"__h{len(c.df.columns)}"
        c.df = number(c.df, name)
        return F.col(name) if c.window else F.sort_array(F.collect_list(name))

    return Expr(go)


def _picked(c: Context, wanted: tuple) -> list[Column]:
    names = [x for x in resolve(c.df.schema, wanted or c.df.columns) if x not in c.groups and not x.startswith("__")]
    return listed(names)


def pick(*wanted: object) -> Expr:
    """A row's values of the chosen columns (without group keys) as one struct."""
    return Expr(lambda c: F.struct(*_picked(c, wanted)))


def cur_data() -> Expr:
    return pick()


def c_across(*wanted: object) -> Expr:
    """A row's values of the chosen columns as one array."""
    return Expr(lambda c: F.array(*_picked(c, wanted)))


_current: list[str] = []


def cur_column() -> str:
    """The name of the column that across works on."""
    if not _current:
        raise ValueError("cur_column is for functions inside across")
    return _current[-1]


def if_any(wanted: list[str], test: Callable[[Column], Column]) -> Expr:
    return Expr(lambda c: _fold([test(column(x)) for x in resolve(c.df.schema, wanted)], lambda a, b: a | b))


def if_all(wanted: list[str], test: Callable[[Column], Column]) -> Expr:
    return Expr(lambda c: _fold([test(column(x)) for x in resolve(c.df.schema, wanted)], lambda a, b: a & b))


def _fold(parts: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = f(out, p)
    return out


@dataclass
class Across:
    columns: list
    functions: dict[str, Callable]
    names: str
    unpack: bool = False

    def expressions(self, c: Context) -> dict[str, object]:
        """Name -> expression, for each column and function; unpack: for each field of a function's struct."""
        out: dict[str, object] = {}
        for x in [x for x in resolve(c.df.schema, self.columns) if x not in c.groups and not x.startswith("__")]:
            for fn, f in self.functions.items():
                _current.append(x)
                try:
                    made, name = f(x), self.names.format(col=x, fn=fn)
                finally:
                    _current.pop()
                kind = c.kind(build(made, Context(c.df, c.groups, c.order))) if self.unpack else None
                if isinstance(kind, T.StructType):
                    out |= {f"{name}_{part}": Expr(lambda c, m=made, p=part: build(m, c)[p]) for part in kind.names}
                else:
                    out[name] = made
        return out


def across(wanted: list | object, functions: Callable | dict[str, Callable], names: str | None = None, unpack: bool = False) -> Across:
    """Functions of each column; one function keeps the column's name, named ones give {col}_{fn}."""
    many = isinstance(functions, dict)
    wanted = list(wanted) if isinstance(wanted, (list, tuple)) else [wanted]
    return Across(wanted, functions if many else {"": functions}, names or ("{col}_{fn}" if many else "{col}"), unpack)
