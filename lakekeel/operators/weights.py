"""Segments, weights and replication factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class NotEnoughCapacity(Exception):
    """The least replication does not fit."""


def absolute_segments(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments with absolute bounds [seg_start, seg_end). Negative offsets count from the dataset's last block, not below
    0; a segment never begins before the one listed ahead of it. segments (dataset, position, seg_from, weight)."""
    last = chunks.groupBy("dataset").agg(F.max("last_block").alias("last_block"))
    order = Window.partitionBy("dataset").orderBy("position")
    start = F.when(F.col("seg_from") < 0, F.greatest(F.lit(0), F.col("last_block") + F.col("seg_from"))).otherwise(F.col("seg_from"))
    own = segments.join(last, "dataset").withColumn("seg_start", start)
    own = own.withColumn("seg_start", F.max("seg_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn("seg_end", F.lead("seg_start").over(order))


def segment_assign(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Each chunk with its last segment that begins at or before it; chunks before the first segment go. Segments are
    configuration, a few rows a dataset, and are joined by dataset."""
    own = segments.select("dataset", "position", "seg_from", "seg_start", "seg_end", F.col("weight").alias("segment_weight"))
    inside = (F.col("first_block") >= F.col("seg_start")) & (F.col("seg_end").isNull() | (F.col("first_block") < F.col("seg_end")))
    return chunks.join(own, "dataset").where(inside)


def segment_stats(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Chunks and bytes of each segment, passed segments without chunks included."""
    used = segment_assign(chunks, segments).groupBy("dataset", "position").agg(F.count("*").alias("num_chunks"), F.sum("size").alias("total_size"))
    last = chunks.groupBy("dataset").agg(F.max("first_block").alias("last_first"))
    reached = segments.join(last, "dataset").where((F.col("seg_start") <= F.col("last_first")) | (F.col("position") == 0))
    stats = reached.join(used, ["dataset", "position"], "left")
    return stats.select("dataset", "seg_from", F.coalesce("num_chunks", F.lit(0)).cast("bigint").alias("num_chunks"), F.coalesce("total_size", F.lit(0)).cast("bigint").alias("total_size"))


def size_by_weight(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("weight").agg(F.sum("size").alias("size"))


def replication_factors(sizes: DataFrame, capacity: DataFrame, min_r: int, max_r: int) -> DataFrame:
    """Replication factor of each weight under a byte budget. sizes (weight, size), capacity (capacity), one row.

    For each weight in rising order, the multiplier that spends what is left once all lower weights have the least
    replication; the first one that reaches the least replication for its own weight (else the last) sets all factors.
    A column `enough` tells whether the least replication fits at all.
    """
    order = Window.orderBy("weight")  # one row per weight: configuration-sized
    below = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum(F.col("size") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing))
    own = sizes.crossJoin(F.broadcast(capacity)).withColumn("_below", below).withColumn("_above", above)
    own = own.withColumn("_m", F.greatest(F.lit(0), F.col("capacity") - F.lit(min_r) * F.col("_below")).cast("double") / F.col("_above").cast("double"))
    own = own.withColumn("_reached", F.floor(F.col("_m") * F.col("weight")) >= min_r)
    pick = own.agg(
        F.coalesce(F.min_by("_m", F.when(F.col("_reached"), F.col("weight"))), F.max_by("_m", "weight")).alias("multiplier"),
        F.sum("size").alias("_total"),
    )
    factor = F.least(F.lit(max_r), F.greatest(F.lit(min_r), F.floor(F.col("weight") * F.col("multiplier"))))
    return own.crossJoin(F.broadcast(pick)).select("weight", "size", factor.cast("bigint").alias("factor"), (F.col("_total") * min_r <= F.col("capacity")).alias("enough"), "multiplier")


def solve_replication(sizes: dict[int, int], capacity: int, min_r: int, max_r: int) -> dict[int, int]:
    """The same for a handful of weights in a dict."""
    weights = sorted(sizes)
    if sum(sizes.values()) * min_r > capacity:
        raise NotEnoughCapacity(f"{capacity} bytes do not hold {min_r} copies")
    multiplier = 0.0
    for i, w in enumerate(weights):
        left = max(0, capacity - min_r * sum(sizes[x] for x in weights[:i]))
        multiplier = left / sum(sizes[x] * x for x in weights[i:])
        if int(multiplier * w) >= min_r:
            break
    return {w: min(max_r, max(min_r, int(w * multiplier))) for w in weights}


def replication_gauge(segments: DataFrame, factors: DataFrame) -> DataFrame:
    """Factor of each configured segment, through its weight."""
    return segments.join(F.broadcast(factors.select("weight", "factor")), "weight", "left").select("dataset", "seg_from", "factor")
