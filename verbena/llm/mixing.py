"""Mixing sources to target weights [native]: fixed-length blocks, multinomial shards, index permutations, block join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_groups, uid, write_table

BLOCK = 256
SHARD_SLOTS = 4096
SEED = 20240229
CAP = 3
#: Shards of a group, whose counts one task sums up; intervals are looked up by so many strips.
SHARD_GROUP, STRIPS = 4096, 4096
#: Steps of a cycle walk. A walk leaves the range for fewer than sqrt(n) steps in a row, as a rule for none.
WALK = 64


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating; they share the whole size by weight; a target stops at cap
    times its source's size and the excess is reshared by weight until none is above. In closed form: by rising
    cap * size / weight, a source is held at its cap as long as its share of what is left would exceed it. Sources are
    metadata: one row each.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % 3 + 1)
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    up = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    t = ranked.select("*", F.sum("source_size").over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"), F.coalesce(F.sum(cap * F.col("source_size")).over(up), F.lit(0)).alias("held"), F.coalesce(F.sum("weight").over(up), F.lit(0)).alias("held_weight"))
    left = (F.col("all_size") - F.col("held")).cast("double")
    left_weight = F.col("all_weight") - F.col("held_weight")
    t = t.withColumn("capped", cap * F.col("source_size") * left_weight < F.col("weight") * left).withColumn("level", left / left_weight)
    # the first source below its cap sets the level of all that follow
    level = F.min_by("level", F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))).over(whole)
    t = t.withColumn("lead_level", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")), F.col("weight") * F.coalesce("lead_level", level)))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, another for each key: a Feistel network on pairs (l, r), l < a and r < b, with
    a * b little over n; what leaves the range goes through the network again."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def through(v: Column) -> Column:
        l, r = F.floor(v / b), F.pmod(v, b)
        for step in range(4):
            if step % 2:
                r = F.pmod(r + F.pmod(F.xxhash64(l, F.lit(SEED + step), *key), b), b)
            else:
                l = F.pmod(l + F.pmod(F.xxhash64(r, F.lit(SEED + step), *key), a), a)
        return l * b + r

    once = through(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda v, _: F.when(v < n, v).otherwise(through(v)))
    return F.when(once < n, once).when(walked < n, walked).otherwise(F.raise_error(F.lit("the cycle walk is too long")).cast("long"))


def _looked_up(rows: DataFrame, value: str, intervals: DataFrame, end: Column) -> DataFrame:
    """Adds to each row the interval (lo, hi and others) that holds its value, 0 <= value < end: an equality join by strip of the range."""
    width = F.greatest(F.lit(1).cast("long"), F.ceil(end / STRIPS))
    strips = intervals.filter("lo < hi").withColumn("strip", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return rows.withColumn("strip", F.floor(F.col(value) / width)).join(strips, "strip").filter(f"lo <= {value} and {value} < hi").drop("strip", "lo", "hi")


def _spans(sources: DataFrame, size: Column, *more: str) -> DataFrame:
    """Sources one after the other as intervals. Sources are metadata, one row each."""
    upto = F.sum(size).over(W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0))
    return sources.select("source", *more, upto.alias("hi"), (upto - size).alias("lo"))


def block_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as slots: (shard, place, source, epoch, j, block_no, words), shard_slots to a shard, fewer in the last.

    A source's quota is its target in words, which gives its number of slots: whole passes (epochs) over its blocks first. For
    each shard the counts of its sources are drawn multinomially, by the quotas: a slot draws a number below the number of
    all slots and takes the source whose interval holds it. Over all shards a source then has a few slots too many or too
    few; those beyond its quota, the last ones, go to sources that lack some. A source's k-th slot is number k of its
    stream: in each epoch the number goes through the epoch's permutation to a block number. The short last block comes
    last, and the last slot is cut to the quota. No window is larger than a shard, a group of shards or the list of sources.
    """
    spark = targets.sparkSession
    t = targets.filter("source_size > 0").select("source", "source_size", F.least(F.round("target"), F.lit(float(CAP)) * F.col("source_size")).cast("long").alias("quota"))
    t = t.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("per_epoch", F.ceil(F.col("source_size") / block))
    t = t.withColumn("n", F.floor(F.col("quota") / F.col("source_size")) * F.col("per_epoch") + F.ceil(F.col("quota") % F.col("source_size") / block)).filter("n > 0")
    t = write_table(t.select(F.struct("source").alias("source"), "source_size", "quota", "full", "per_epoch", "n"), "quotas")
    total = t.agg(F.sum("n")).first()[0] or 0
    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("place"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, total))).alias("draw"))
    drawn = write_table(_looked_up(drawn, "draw", _spans(t, F.col("n")), F.lit(total)).drop("draw"), "drawn")

    counts = shard_counts(drawn).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    groups = counts.groupBy("source", "group").agg(F.sum("n_slots").alias("n_group"))
    before = lambda by, order, x: (F.sum(x).over(W.partitionBy(*by).orderBy(order)) - F.col(x))
    groups = groups.select("source", "group", before(["source"], "group", "n_group").alias("group_base"))
    bases = counts.withColumn("base", before(["source", "group"], "shard", "n_slots")).join(groups, ["source", "group"]).select("shard", "source", (F.col("base") + F.col("group_base")).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "source").orderBy("place")) - 1
    ranked = drawn.withColumn("rank", rank).join(bases, ["shard", "source"]).select("shard", "place", "source", (F.col("base") + F.col("rank")).alias("k"))

    have = write_table(t.join(counts.groupBy("source").agg(F.sum("n_slots").alias("have")), "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))), "have")
    over, under = F.greatest(F.col("have") - F.col("n"), F.lit(0)), F.greatest(F.col("n") - F.col("have"), F.lit(0))
    moved = have.agg(F.coalesce(F.sum(over), F.lit(0))).first()[0]
    own = write_table(ranked.join(_spans(have, over, "n").withColumnRenamed("lo", "first_over").drop("hi"), "source"), "ranked")
    kept = own.filter("k < n").select("shard", "place", "source", "k")
    spare = own.filter("k >= n").select("shard", "place", (F.col("first_over") + F.col("k") - F.col("n")).alias("number"))
    lacking = _spans(have, under, "have").withColumn("first_under", F.col("lo"))
    settled = _looked_up(spare, "number", lacking, F.lit(moved)).select("shard", "place", "source", (F.col("have") + F.col("number") - F.col("first_under")).alias("k"))
    slots = kept.unionByName(settled).join(t, "source")

    epoch, j = F.floor(F.col("k") / F.col("per_epoch")), F.pmod("k", "per_epoch")
    slots = slots.withColumn("name", F.col("source.source")).withColumn("epoch", epoch).withColumn("j", j).withColumn("left", F.col("quota") - F.col("epoch") * F.col("source_size"))
    block_no = F.when(F.col("j") >= F.col("full"), F.col("j")).otherwise(_permuted(F.col("j"), F.col("full"), F.col("name"), F.col("epoch")))
    words = F.least(F.lit(block).cast("long"), F.least(F.col("left"), F.col("source_size")) - F.col("j") * block)
    return slots.select("shard", "place", F.col("name").alias("source"), "epoch", "j", block_no.alias("block_no"), words.alias("words"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """The number of slots of each source in each shard."""
    return slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n_slots"))


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep_uid: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, source, size, start), and sources (source, source_size). start is the first word's place in the source's stream of words.

    The stream's order is that of a hash of id and text, so it doesn't depend on how the rows come; equal rows are alike.
    Two-level prefix sums: by bucket of a source, then within the bucket, so that no task orders a whole source.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    place = F.xxhash64(F.col(id_col).cast("string"), text, F.lit(SEED))
    rows = write_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), place.alias("h"), (F.col("__uid") if keep_uid else uid()).alias("uid")), "sizes")
    bucket = F.pmod("h", F.lit(max(64, rows.count() // 10_000)))
    rows = rows.withColumn("at", F.struct("source", bucket.alias("bucket")))
    sums = rows.groupBy("at").agg(F.sum("size").alias("bucket_size"))
    sums = write_table(sums.select("at", (F.sum("bucket_size").over(W.partitionBy("at.source").orderBy("at.bucket")) - F.col("bucket_size")).alias("base"), "bucket_size"), "buckets")
    inner = F.sum("size").over(W.partitionBy("at").orderBy("h", "id", "uid").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("start", inner).join(sums.hint("merge"), "at").select("uid", "id", "source", "size", (F.col("start") + F.col("base")).alias("start"))
    return write_table(rows, "packed"), sums.groupBy("at.source").agg(F.sum("bucket_size").alias("source_size"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The rows once for each block that they reach into, at: (source, block_no); rows without words reach into a block of their own that isn't one."""
    none = F.array(-1 - F.col("uid"))
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).otherwise(none)
    pieces = rows.withColumn("block_no", F.explode(span))
    base = F.col("block_no") * block
    return pieces.select("uid", "id", "source", "size", F.struct("source", "block_no").alias("at"), F.greatest(base - F.col("start"), F.lit(0)).alias("from"), F.greatest(F.col("start") - base, F.lit(0)).alias("lo"), F.least(F.col("start") + F.col("size") - base, F.lit(block)).alias("hi"))


def _drawn(slots: DataFrame) -> DataFrame:
    """at -> the lengths of its block's slots, longest first: a block is drawn whole several times and, for the last slot, in part at most once."""
    return slots.groupBy(F.struct("source", "block_no").alias("at")).agg(F.sort_array(F.collect_list("words"), False).alias("lengths"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, n_slots.

    size: words of the text (null: 0). taken: the words that the mix takes from the row, repeats counted; at most three
    times its size, and per source exactly the rounded target. n_slots: in how many slots of the mix the row's blocks are.
    Rows repeated in the input count each for themselves; a null source is a source. Reruns agree, however the rows are
    split among files and tasks. An empty table gives an empty result; columns other than the three are not read.
    """
    rows, sizes = packed(docs, id_col, text_col, source_col)
    targets = write_table(source_targets(sizes), "targets")
    drawn = write_table(_drawn(block_slots(targets, block, shard_slots)), "blocks")
    zero = F.lit(0).cast("long")
    taken = F.aggregate("lengths", zero, lambda t, x: t + F.greatest(zero, F.least(F.col("hi"), x) - F.col("lo")))
    met = _pieces(rows, block).join(drawn.hint("merge"), "at", "left")
    got = met.groupBy("uid", "id", "source", "size").agg(F.coalesce(F.sum(taken), zero).alias("taken"), F.coalesce(F.sum(F.size("lengths").cast("long")), zero).alias("n_slots"))
    stats = targets.select(F.struct("source").alias("src"), "source_size", "target")
    out = join_groups(write_table(got.withColumn("src", F.struct("source")), "taken"), stats, "src")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "n_slots")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as output shards: (shard, place, source, block_no, words, text), a row per slot, text its words with a space between."""
    held = write_table(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)).withColumn("__uid", uid()), "mixed")
    rows, sizes = packed(held, id_col, text_col, source_col, keep_uid=True)
    slots = block_slots(write_table(source_targets(sizes), "targets"), block, shard_slots)
    pieces = _pieces(rows.filter("size > 0"), block).groupBy("uid").agg(F.collect_list(F.struct("at", "from", "lo", "hi")).alias("ps"))
    words = F.filter(F.split(text_col, SPACE), lambda x: x != "")
    parts = held.join(pieces, held["__uid"] == pieces["uid"]).select(words.alias("w"), F.explode("ps").alias("p"))
    parts = parts.select("p.at", F.struct("p.lo", F.slice("w", (F.col("p.from") + 1).cast("int"), (F.col("p.hi") - F.col("p.lo")).cast("int")).alias("w")).alias("part"))
    blocks = write_table(parts.groupBy("at").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["w"])).alias("w")), "blocks")
    met = slots.withColumn("at", F.struct("source", "block_no")).join(blocks, "at")
    return met.select("shard", "place", "source", "block_no", "words", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents, with the columns of docs: a row per document and copy, with the words that the copy takes.

    A document drawn whole keeps its text; one drawn in part has those words, a space between. Copy n holds what is drawn
    at least n times, so a document has at most three (its last block may add one). Documents without words go, as does
    what isn't drawn; null sources and ids are as others, repeated rows count each for themselves, and an empty table gives
    no rows. chars_col, if there is one, is set to the new length.
    """
    held = write_table(docs.withColumn("__uid", uid()), "mixed")
    rows, sizes = packed(held, id_col, text_col, source_col, keep_uid=True)
    drawn = write_table(_drawn(block_slots(write_table(source_targets(sizes), "targets"), block, shard_slots)), "blocks")
    copies = _pieces(rows.filter("size > 0"), block).join(drawn.hint("merge"), "at").select("uid", "size", "from", "lo", "hi", F.posexplode("lengths").alias("copy", "length"))
    copies = copies.withColumn("n", F.least("hi", "length") - F.col("lo")).filter("n > 0")
    plan = copies.groupBy("uid", "copy").agg(F.sort_array(F.collect_list(F.struct("from", "n"))).alias("ranges"), F.sum("n").alias("words"), F.first("size").alias("size"))
    words = F.filter(F.split(text_col, SPACE), lambda x: x != "")
    out = held.join(plan.withColumnsRenamed({c: f"__{c}" for c in ("uid", "copy", "ranges", "words", "size")}).hint("shuffle_hash"), "__uid")
    text = F.when(F.col("__words") == F.col("__size"), F.col(text_col)).otherwise(F.array_join(F.flatten(F.transform("__ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), r["n"].cast("int")))), " "))
    out = out.withColumn(text_col, text)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select([f"`{c}`" for c in docs.columns])
