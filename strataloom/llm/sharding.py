"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by a hash of the text, so that equal texts stand side by side in a random order. Each partition sums its own
rows; the totals of the partitions (one row each) give every partition its offset; offset plus local prefix sum is a row's place on the
line of all bytes, which is cut at equal targets. Equal texts share the place of the first of them, so they always share a shard.

Large groups of equal texts (more than HEAVY of a shard's target, so at most shards / HEAVY of them) would unbalance that. They are put
on the shards first, each on the one with the fewest bytes, the largest group first; the line of all other rows is then cut at what each
shard lacks. So shards differ by at most a few times HEAVY of the target and a row, unless one group alone is larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, table

SHARDS, HEAVY = 8, 0.005


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, heavy: float = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes and the checksum of the empty text. law is always 'bytes';
    grown_shard is null, as cuts move when shards are added. Rows with equal text (128 bits of hash; null and empty texts are equal) are
    always in one shard. Repeated rows are rows of their own with slots of their own; ties in (text, id) are equal rows, whichever comes
    first. Other columns are ignored, whatever their names. An empty table gives an empty result; a very long text is one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit("second")).alias("h2"))
    # one row
    total = rows.agg(F.sum("size").alias("total"))
    # texts with more than the share of bytes: fewer than shards / heavy rows, whatever the input
    hot = rows.groupBy("h", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1").join(F.broadcast(total), F.col("bytes") * shards > F.col("total") * heavy)
    pick = lambda acc, x: let(F.array_position(acc["load"], F.array_min(acc["load"])), lambda p: F.struct(
        F.transform(acc["load"], lambda y, k: F.when(k == p - 1, y + x["bytes"]).otherwise(y)).alias("load"),
        F.concat(acc["put"], F.array(F.struct(x["h"].alias("h"), x["h2"].alias("h2"), (p - 1).cast("int").alias("heavy")))).alias("put"),
    ))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<struct<h:bigint,h2:bigint,heavy:int>>").alias("put"))
    groups = F.sort_array(F.collect_list(F.struct("bytes", "h", "h2")), asc=False)
    # one row: the bytes that each shard has, and the shard of each heavy group
    placed = cut(hot.agg(groups.alias("g")).select(F.aggregate("g", start, pick).alias("x")).select("x.load", "x.put"))
    chosen = placed.select(F.inline("put"))
    rows = rows.join(F.broadcast(chosen), ["h", "h2"], "left")
    # the partition number must not change once the totals are taken
    ranged = cut(rows.repartitionByRange("h", "h2", F.coalesce("heavy", F.lit(-1)), F.when(F.col("heavy").isNotNull(), F.col("i"))).withColumn("pid", F.spark_partition_id()))
    light = F.when(F.col("heavy").isNull(), F.col("size")).otherwise(0)
    totals = ranged.groupBy("pid").agg(F.sum(light).alias("bytes"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.sum("bytes").over(Window.partitionBy()).alias("light"))
    local = Window.partitionBy("pid").orderBy("h", "h2", "i", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    where = ranged.withColumn("end", F.sum(light).over(local)).join(F.broadcast(offsets), "pid").join(F.broadcast(placed.select("load")), F.lit(True))
    where = where.withColumn("start", F.col("bytes0") + F.col("end") - F.when(F.col("heavy").isNull(), F.col("size")).otherwise(0))
    # the first of equal texts has the least place; a light text stands in one partition, as the range is by its hash
    where = where.withColumn("at", F.min("start").over(Window.partitionBy("pid", "h", "h2").orderBy("i", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # all shards are filled to one level, but for those that heavy groups lift above it
    level = let(F.sort_array("load"), lambda all_: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.when(  # no level where a shard is above it
        (F.col("light") + F.aggregate(F.slice(all_, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)) >= F.get(all_, k - 1) * k,
        (F.col("light") + F.aggregate(F.slice(all_, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)) / k,
    ))))
    lacks = lambda lvl: F.transform("load", lambda x: F.greatest(lvl - x, F.lit(0.0)))
    middle = F.col("at") + F.col("size") / 2
    # the first shard whose share of the line ends behind the row's middle
    ends = let(lacks(level), lambda need: F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice(need, 1, k), F.lit(0.0), lambda a, x: a + x)))
    cutting = let(ends, lambda all_: F.least(F.size(F.filter(all_, lambda x: x <= middle)), F.lit(shards - 1)))
    dealt = cut(where.withColumn("shard", F.coalesce("heavy", cutting)).select("pid", "i", "size", "crc", "h", "h2", "shard"))
    # slots: rows of a shard in the partitions before, and those before in this one
    counts = dealt.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "pid", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    slot = F.row_number().over(Window.partitionBy("pid", "shard").orderBy("h", "h2", "i", "size")) - 1 + F.col("n0")
    out = dealt.join(F.broadcast(first), ["shard", "pid"])
    return out.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op7_sharding": op7_sharding}, {}
