"""Contiguous balanced shards from global byte-size prefix sums, in built-in functions only.

Rows are put in order of id by range partitioning; each partition's total makes its offset, and
offset plus running sum is a row's global prefix.  The prefix is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: none plus 1).  Shards are contiguous in the order
    (doc_id, null first; then checksum, size), and the middle byte of a row decides: shard =
    ``floor(middle * shards / total)``, so a shard's bytes differ from the mean by the largest row
    at most.  slot counts from 0 in each shard.  law is ``bytes``; grown_shard is null.  An empty
    table gives no rows; with fewer rows than shards some shards are empty.

    Only ids, sizes and checksums are shuffled.  Range bounds come from a sample, so the ordered
    rows are written once before totals are taken.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # the last part of the order splits rows that are equal in all else; it has no effect on others
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", "text_crc32", "size", "tie")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()), "ordered")

    # one row for each partition: its offset in bytes and rows
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), zero).alias("byte0"), F.coalesce(F.sum("rows").over(before), zero).alias("row0"), F.sum("bytes").over(every).alias("total"))

    own = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size", "tie")
    placed = ordered.withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(own).cast("long"))
    placed = placed.join(F.broadcast(offsets), "part")  # as many rows as partitions
    middle = 2 * (F.col("byte0") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("middle", middle).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(middle * {shards} div (2 * total) as int)")))
    placed = placed.withColumn("row", F.col("row0") + F.col("place") - 1)
    heads = placed.groupBy("shard").agg(F.min("row").alias("head"))  # as many rows as shards
    return placed.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
