"""Rings and receive buffers of bounded size, and who reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bytes of a receive buffer; longer frames are cut.
FRAME = 2048


def heads(published: DataFrame, ring: str = "market_id") -> DataFrame:
    return published.groupBy(ring).agg(F.count("*").alias("head"))


def content(published: DataFrame, ring: str = "market_id", order: str = "ord", capacity: int = 64) -> DataFrame:
    """The last `capacity` rows of each ring with seq (from 1, in order), slot and head. Tasks keep a ring's last rows before they are shuffled."""
    w = Window.partitionBy(ring).orderBy(F.desc(order))
    last = published.withColumn("__rg_back", F.row_number().over(w)).filter(F.col("__rg_back") <= capacity)
    out = last.join(F.broadcast(heads(published, ring)), ring)  # as many rows as rings
    seq = F.col("head") - F.col("__rg_back") + 1
    return out.withColumn("seq", seq).withColumn("slot", F.expr(f"CAST(seq % {capacity} AS INT)")).drop("__rg_back")


def reads(readers: DataFrame, rings: DataFrame, ring: str = "market_id", capacity: int = 64) -> DataFrame:
    """One read of each reader (reader, ring, cursor; null: from the head): status ok, empty or overrun, missed, the cursor after it, and the row read.

    `rings` is `content`; a reader that the ring has left behind by more than its capacity is set to the oldest row that it holds.
    """
    heads_of = rings.groupBy(ring).agg(F.max("head").alias("head"))
    at = readers.join(F.broadcast(heads_of), ring, "left").withColumn("head", F.coalesce("head", F.lit(0))).withColumn("cursor", F.coalesce("cursor", "head"))
    status = F.when(F.col("cursor") >= F.col("head"), "empty").when(F.col("head") > F.col("cursor") + capacity, "overrun").otherwise("ok")
    at = at.withColumn("status", status).withColumn("missed", F.when(status == "overrun", F.col("head") - F.col("cursor") - capacity).otherwise(0))
    at = at.withColumn("next", F.when(status == "ok", F.col("cursor") + 1).when(status == "overrun", F.col("head") - capacity).otherwise(F.col("cursor")))
    slots = rings.drop("head", "slot").withColumnRenamed("seq", "__rg_seq")
    read = at.withColumn("__rg_seq", F.when(F.col("status") == "ok", F.col("next"))).join(slots, [ring, "__rg_seq"], "left")
    return read.drop("__rg_seq")


def received(packets: DataFrame, source: str, order: str, payload: str, capacity: int = 512) -> DataFrame:
    """Packets that found a free buffer, cut to FRAME bytes: the first `capacity` of each source, since nothing polls in between."""
    w = Window.partitionBy(source).orderBy(order)
    return packets.withColumn("__rx", F.row_number().over(w)).filter(F.col("__rx") <= capacity).drop("__rx").withColumn(payload, F.expr(f"substring(`{payload}`, 1, {FRAME})"))


def receive_counters(packets: DataFrame, source: str, order: str, payload: str, capacity: int = 512) -> DataFrame:
    """Of each source: packets and bytes received, frames cut, packets dropped for want of a buffer."""
    offered = packets.groupBy(source).agg(F.count("*").alias("offered"))
    w = Window.partitionBy(source).orderBy(order)
    size = F.octet_length(payload)
    taken = packets.select(source, order, size.alias("__size")).withColumn("__rx", F.row_number().over(w)).filter(F.col("__rx") <= capacity)
    sums = taken.groupBy(source).agg(F.count("*").alias("packets"), F.sum(F.least("__size", F.lit(FRAME))).cast("bigint").alias("bytes"), F.count_if(F.col("__size") > FRAME).alias("cut"))
    return offered.join(sums, source).select(source, "packets", "bytes", "cut", (F.col("offered") - F.col("packets")).alias("dma_errors"))
