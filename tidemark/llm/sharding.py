"""Contiguous shards of near equal bytes, from global prefix sums. DataFrame functions only.

Rows are put in key order by range partitioning; each partition's total is one row; a running sum over those few
rows gives every partition's offset, and a running sum inside a partition gives every row's. Shard boundaries are
the equal targets total * k / shards: a row belongs to the shard in which its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def byte_shards(docs: DataFrame, scratch: Scratch, shards: int = 8, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes + 1), text_crc32, law 'bytes', shard, slot, grown_shard (null).

    Null text: size 1, crc32 of no bytes (0). Null keys come first. Repeated keys and wholly repeated rows are rows
    of their own, ordered by size, crc and then as read. An empty table gives no rows. A row of a third of all
    bytes makes its own shard large and may leave others empty; slots are gapless in each shard. Other columns
    are ignored, whatever their names. Shuffled are three numbers a row, never the text.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ranged = scratch.table(rows.repartitionByRange(n, "k", "size", "crc", "tie").withColumn("part", F.spark_partition_id()), "ranged")
    # one row per partition: at most n rows, whatever the input's size
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c0"),
        F.sum("b").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    own = Window.partitionBy("part").orderBy("k", "size", "crc", "tie")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(offsets), "part")
        .select(
            "k", "size", "crc",
            (F.col("nth") - 1 + F.col("c0")).alias("nth"),
            # twice the middle byte, so that all stays in integers
            F.expr(f"cast(least({shards - 1}, (cast(2 * (b0 + upto) - size as decimal(38,0)) * {shards}) div (2 * total)) as int)").alias("shard"),
        )
    )
    placed = scratch.table(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
