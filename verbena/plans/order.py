"""Row numbers without a single task, and unique names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

ROW, NUMBER = "__row", "__number"


def quoted(name: str) -> str:
    """A column's name as Spark parses names: dots and backticks in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def listed(names: list[str]) -> list[Column]:
    return [column(n) for n in names]


@dataclass(frozen=True)
class Key:
    """A sort key: missing values last, either way."""

    value: Column
    kind: T.DataType
    down: bool = False

    @property
    def sort(self) -> Column:
        return sort_key(self.value, self.kind, self.down)

    @property
    def flip(self) -> Key:
        return Key(self.value, self.kind, not self.down)


def by_row() -> list[Key]:
    return [Key(F.col(ROW), T.LongType())]


def with_row(df: DataFrame) -> DataFrame:
    """A hidden column that follows the source's row order."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys, nulls equal; the right one's other columns come last."""
    rest = [c for c in right.columns if c not in keys]
    right = right.select(*(column(k).alias(f"__k{i}") for i, k in enumerate(keys)), *listed(rest))
    on = [column(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(right, on, how).drop(*(f"__k{i}" for i in range(len(keys))))


def number(df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """Consecutive numbers from 1, in row order or that given; distributed, unlike a window over everything."""
    df = df.orderBy(*order) if order else df
    return df.select("*", (InternalFunction.distributed_sequence_id() + 1).cast("long").alias(name))


def sort_key(column: Column, kind: T.DataType, descending: bool = False) -> Column:
    """Missing values last, either way; NaN is missing."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        column = F.nullif(column, F.lit(float("nan")))
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def unused(name: str, taken: list[str], pad: str = "n") -> str:
    """name, or with more pads (for pad "": numbered from 2) until no column has it."""
    i, out = 2, name
    while out in taken:
        out, i = (out + pad, i) if pad else (f"{name}{i}", i + 1)
    return out
