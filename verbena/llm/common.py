"""Shared plumbing of the corpus operators: scratch tables, skew-safe joins, narrow Bloom filters."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column
from pyspark.sql.internal import InternalFunction

#: ASCII white space as the contracts write it, and its complement (a word).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of
    its own; on a cluster that is an error, as executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verbena-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/verbena-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """What is left of the scratch tables goes when the application ends."""
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    drop_path(df.sparkSession, df._scratch)
    _made.remove((df.sparkSession, df._scratch))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def uid() -> Column:
    """A number per row; stable only once written."""
    return F.monotonically_increasing_id()


def row_name(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text, whatever the id's type, nulls and repeated ids included: a struct, equal for equal rows only
    (but for a chance collision of 64-bit hashes under one id)."""
    i = F.col(id_col).cast("string")
    return F.struct(i.alias("id"), F.xxhash64(i, F.coalesce(F.col(text_col), F.lit(""))).alias("key"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join of rows with one row per key, whatever the skew of the keys.

    The groups are written first, so that both sides of the join are plain shuffles: of such, adaptive execution splits a
    partition of rows that is too large (a hot key, or the rows without a key) over several tasks. It broadcasts the groups
    only below its own size threshold.
    """
    added = [c for c in groups.columns if c != key]
    return rows.join(write_table(groups, "groups"), key, "left").select(*rows.columns, *added)


def bloom_of(df: DataFrame, value: Column, expected: int) -> Column:
    """A Bloom filter of 64-bit values as a scalar subquery. Spark bounds its size by
    ``spark.sql.optimizer.runtime.bloomFilter.maxNumBits`` (8 MiB unless changed); a full filter only lets more rows through."""
    bits = max(1 << 16, 12 * expected)
    agg = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", value, F.lit(max(expected, 1000)).cast("long"), F.lit(bits).cast("long"))
    return df.agg(agg.alias("f")).scalar()


def might_contain(bloom: Column, value: Column) -> Column:
    """True for every member and for few others; false if the filter is of no rows."""
    jvm = SparkContext._active_spark_context._jvm
    expr = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(expr(bloom._jc), expr(value._jc))
    return F.coalesce(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(test)), F.lit(False))


def rows_with_keys(rows: DataFrame, keys: DataFrame, key: str, expected: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, the others): a narrow filter, so that only the first part needs to shuffle."""
    hit = might_contain(bloom_of(keys, F.xxhash64(key), expected), F.xxhash64(F.col(key)))
    return rows.filter(hit), rows.filter(~hit)


def _star(edges: DataFrame, low: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Hangs b of every edge (a, b) on the smallest node of a's neighbourhood."""
    low = write_table(low, "low")
    got = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if more is not None:
        got = got.union(low.select("a", F.col("m").alias("b")))
    made = write_table(got.filter("a <> b").distinct(), "edges")
    drop_table(low)
    return made


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): no step adds edges, and the number of steps is
    logarithmic. Each step is a small plan over written tables: minima with map-side combine, then a join whose skew (the
    edges of a hub) adaptive execution splits. Settled when a round changes neither number nor hash of the edges.
    """
    seen = None
    e = write_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen or not now[0]:
            return e.toDF("node", "root").union(e.select("b").distinct().select("b", "b"))
        seen = now
        # large star: every larger neighbour of a node hangs on the smallest of the node's neighbourhood
        up = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        big = _star(up, e.union(up).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        drop_table(e)
        # small star: the smaller neighbours of a node, and the node itself, hang on the smallest of them
        e = _star(big, big.groupBy("a").agg(F.min("b").alias("m")), big)
        drop_table(big)
    raise RuntimeError("components did not settle")
