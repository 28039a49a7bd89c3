"""Exact dedup [native]: two-pass Bloom filtering, so that only possibly repeated rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bloom_of, join_groups, might_contain, uid, write_table

#: Cells of the counting pass: about 16 for each row, at most 2**34 in each half.
MOST_CELLS = 1 << 34


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text is an empty one. Of
    equal texts the row with the smallest id stays (null ids come last; of repeated rows with that id, one stays).

    Pass one counts, for each row, two cells picked by its hash (a counting Bloom filter held sparsely: only 8-byte cell
    numbers shuffle, after a map-side combine) and turns the cells seen twice into a Bloom filter of bounded size. Pass two
    probes it: rows with a cell seen once are unique and pass straight through; the others meet by digest. An empty table
    gives an empty result; columns other than the two are not read.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = write_table(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha")).withColumn("uid", uid()), "digests")
    total = rows.count()
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(10, (16 * total).bit_length()))
    h = F.xxhash64("sha")
    first, second = h.bitwiseAND(F.lit(cells - 1)), F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(cells - 1)) + F.lit(cells)
    repeated = rows.select(F.explode(F.array(first, second)).alias("cell")).groupBy("cell").count().filter("count > 1")
    seen = bloom_of(repeated, F.xxhash64("cell"), total)
    flag = rows.withColumn("again", might_contain(seen, F.xxhash64(first)) & might_contain(seen, F.xxhash64(second)))
    flag = write_table(flag, "flagged")
    once, again = flag.filter("not again").drop("again"), flag.filter("again").drop("again")
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid"))).alias("best")
    groups = again.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size"))
    met = join_groups(again, groups, "sha")
    out = met.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "sha")
    out = out.unionByName(once.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
