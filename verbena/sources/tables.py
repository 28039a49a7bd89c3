"""Tables from values, vectors and files; combinations of values; and back to Python."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Tidy, tidy
from ..plans.order import column, unused


def new_tbl(spark: SparkSession, *unnamed: object, nrows: int | None = None, recycle: bool = True, name_repair: bool = True, **named: object) -> Tidy:
    """A table from equally long lists; with recycle single values repeat; a callable gets the columns before it. Unnamed
    columns come first and are named by place; name_repair=False refuses them."""
    if unnamed and not name_repair:
        raise ValueError("columns without names")
    made: dict[str, object] = dict(zip(repair_names([""] * len(unnamed), list(named)), unnamed, strict=True))
    for k, v in named.items():
        made[k] = v(made) if isinstance(v, Callable) else v
    lists = {k: list(v) if isinstance(v, (list, tuple, range)) else [v] for k, v in made.items() if v is not None}
    size = nrows if nrows is not None else max(map(len, lists.values()), default=0)
    if any(len(v) not in ((1, size) if recycle else (size,)) for v in lists.values()):
        raise ValueError("columns differ in length")
    if not lists:
        return Tidy(spark.range(size).select())
    rows = list(zip(*(v if len(v) == size else v * size for v in lists.values()), strict=True))
    return Tidy(spark.createDataFrame(rows, list(lists)))


def as_tbl(x: object, spark: SparkSession | None = None) -> Tidy:
    return tidy(x) if isinstance(x, (Tidy, DataFrame)) else Tidy((spark or SparkSession.active()).createDataFrame(x))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: object) -> Tidy:
    return Tidy(spark.read.format(kind).options(**options).load(path))


def write_table(x: object, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    tidy(x).df.write.format(kind).mode(mode).partitionBy(*(partition_by or [])).save(path)


def enframe(x: object, spark: SparkSession | None = None, name: str = "name", value: str = "value") -> Tidy:
    """A dict or list as (name, value) rows; a frame as (column, array of its values)."""
    if isinstance(x, (Tidy, DataFrame)):
        df = tidy(x).df
        lists = df.agg(*(F.collect_list(column(c)).alias(c) for c in df.columns))
        pairs = F.array(*(F.struct(F.lit(c).alias(name), column(c).cast("array<string>").alias(value)) for c in df.columns))
        return Tidy(lists.select(F.explode(pairs).alias("p")).select("p.*"))
    items = list(x.items()) if isinstance(x, dict) else list(enumerate(x, 1))
    return Tidy((spark or SparkSession.active()).createDataFrame(items, [name, value]))


def deframe(x: object) -> list | dict:
    """One column: a list; two: a dict."""
    df = tidy(x).df
    if not 1 <= len(df.columns) <= 2:
        raise ValueError("deframe takes one or two columns")
    rows = df.collect()
    return [r[0] for r in rows] if len(df.columns) == 1 else {r[0]: r[1] for r in rows}


def list_tidy(*unnamed: object, keep_null: bool = True, named: bool = False, **values: object) -> dict | list:
    """Values in order; a callable gets those before it. Without any name a list, unless named asks for names by place."""
    out: dict[str, object] = {}
    for k, v in [*zip(repair_names([""] * len(unnamed), list(values)), unnamed, strict=True), *values.items()]:
        v = v(out) if isinstance(v, Callable) else v
        if v is not None or keep_null:
            out[k] = v
    return list(out.values()) if unnamed and not values and not named else out


def crossing(*frames: object, sort: bool = False) -> Tidy:
    """Distinct rows of each, all combinations."""
    parts = [tidy(f).df.distinct() for f in frames]
    out = reduce(lambda a, b: a.crossJoin(b), parts)
    return Tidy(out).arrange(*out.columns) if sort else Tidy(out)


def nesting(x: object, *columns: str, sort: bool = False) -> Tidy:
    """Combinations that occur together."""
    out = tidy(x).df.select(*map(column, columns or tidy(x).df.columns)).distinct()
    return Tidy(out).arrange(*out.columns) if sort else Tidy(out)


def repair_names(names: list[str], taken: list[str] | None = None) -> list[str]:
    """Blank names become col_<place>, repeated ones get a number."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        out.append(unused(n or f"col_{i}", out + (taken or []), ""))
    return out
