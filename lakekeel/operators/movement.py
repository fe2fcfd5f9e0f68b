"""How much data a change of placement moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["chunk_pk", "worker_pk"]


def pair_flags(before: DataFrame, after: DataFrame, stale_before: DataFrame | None = None, stale_after: DataFrame | None = None) -> DataFrame:
    """Rows per (chunk, worker) with what held it: ideal or physically (ideal or draining), before and after. One union and one
    aggregation, instead of joins of four tables."""
    def side(df: DataFrame, *flags: int) -> DataFrame:
        return df.select(*PAIR, *[F.lit(f).alias(n) for f, n in zip(flags, ("ideal_b", "ideal_a", "held_b", "held_a"))])

    parts = side(before, 1, 0, 1, 0).unionByName(side(after, 0, 1, 0, 1))
    if stale_before is not None:
        parts = parts.unionByName(side(stale_before, 0, 0, 1, 0))
    if stale_after is not None:
        parts = parts.unionByName(side(stale_after, 0, 0, 0, 1))
    return parts.groupBy(*PAIR).agg(*[F.max(n).alias(n) for n in ("ideal_b", "ideal_a", "held_b", "held_a")])


def data_movement(before: DataFrame, after: DataFrame, sizes: DataFrame, stale_before: DataFrame | None = None, stale_after: DataFrame | None = None) -> DataFrame:
    """One row of totals. Per chunk placed both times: copies gained and lost on disk, dropped from the ideal; a
    dropped copy pairs with a gained one to make a move, more gains are growth, more drops shed replicas."""
    pairs = pair_flags(before, after, stale_before, stale_after)
    chunk = pairs.groupBy("chunk_pk").agg(
        F.max("held_b").alias("was"), F.max("held_a").alias("isnow"),
        F.sum(F.when((F.col("held_a") == 1) & (F.col("held_b") == 0), 1).otherwise(0)).alias("gained"),
        F.sum(F.when((F.col("held_a") == 0) & (F.col("held_b") == 1), 1).otherwise(0)).alias("lost"),
        F.sum(F.when((F.col("ideal_b") == 1) & (F.col("ideal_a") == 0), 1).otherwise(0)).alias("dropped"),
    ).join(sizes.select("chunk_pk", "size"), "chunk_pk", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    both = (F.col("was") == 1) & (F.col("isnow") == 1)
    moved = F.least("gained", "dropped")
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("bigint")
    return chunk.agg(
        total(both & (moved > 0), F.lit(1)).alias("shuffled_chunks"), total(both, moved).alias("shuffled_copies"),
        total(both, moved * F.col("size")).alias("shuffled_bytes"),
        total(both, F.greatest(F.lit(0), F.col("gained") - F.col("dropped")) * F.col("size")).alias("increased_bytes"),
        total(both, F.greatest(F.lit(0), F.col("dropped") - F.col("gained")) * F.col("size")).alias("shed_bytes"),
        total(F.col("was") == 1, F.col("lost") * F.col("size")).alias("freed_bytes"),
        total(F.col("was") == 0, F.col("gained") * F.col("size")).alias("new_bytes"),
    )


def shuffle_share(movement: DataFrame) -> DataFrame:
    """Share of moves in all downloads of existing chunks, in percent."""
    all_bytes = F.col("shuffled_bytes") + F.col("increased_bytes")
    return movement.withColumn("shuffle_share", F.when(all_bytes > 0, F.col("shuffled_bytes") * 100.0 / all_bytes).otherwise(F.lit(0.0)))


def workers_affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct workers that receive new chunks, receive existing ones, or lose copies."""
    pairs = pair_flags(before, after)
    w = Window.partitionBy("chunk_pk")
    own = pairs.withColumn("was", F.max("held_b").over(w))
    gains = (F.col("held_a") == 1) & (F.col("held_b") == 0)
    count = lambda c: F.count_distinct(F.when(c, F.col("worker_pk"))).alias
    return own.agg(count(gains & (F.col("was") == 0))("receiving_new"), count(gains & (F.col("was") == 1))("receiving_existing"), count((F.col("held_b") == 1) & (F.col("held_a") == 0))("losing"))


def worker_bytes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    return pairs.join(sizes.select("chunk_pk", "size"), "chunk_pk").groupBy("worker_pk").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


def least_load(pairs: DataFrame, sizes: DataFrame, stale_below: int) -> DataFrame:
    """One row: the least bytes of a worker that holds anything, how many hold less than the bound, and whether that calls for a warning."""
    loads = worker_bytes(pairs, sizes)
    below = F.count(F.when(F.col("bytes") < stale_below, 1))
    return loads.agg(F.min("bytes").alias("least"), below.alias("below"), F.coalesce(F.min("bytes") < stale_below, F.lit(False)).alias("warned"))


def worker_reshuffle(before: DataFrame, after: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per worker bytes before, after, removed, added and kept; churn in percent of what it held."""
    pairs = pair_flags(before, after).join(sizes.select("chunk_pk", "size"), "chunk_pk")
    total = lambda b, a: F.sum(F.when((F.col("held_b") == b) & (F.col("held_a") == a), F.col("size")).otherwise(0)).cast("bigint")
    own = pairs.groupBy("worker_pk").agg(total(1, 0).alias("removed"), total(0, 1).alias("added"), total(1, 1).alias("kept"))
    return own.select(
        "worker_pk", (F.col("kept") + F.col("removed")).alias("before_bytes"), (F.col("kept") + F.col("added")).alias("after_bytes"), "removed", "added", "kept",
        F.when(F.col("kept") + F.col("removed") == 0, "new").when(F.col("kept") + F.col("added") == 0, "departed").otherwise("common").alias("presence"),
    )


def per_worker_downloads(before: DataFrame, after: DataFrame, sizes: DataFrame, workers: DataFrame) -> DataFrame:
    """Bytes each worker fetches, 0 for those that fetch nothing."""
    gained = after.select(*PAIR).join(before, PAIR, "left_anti").join(sizes.select("chunk_pk", "size"), "chunk_pk").groupBy("worker_pk").agg(F.sum("size").alias("bytes"))
    return workers.select("worker_pk").join(gained, "worker_pk", "left").select("worker_pk", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def reshuffle_percentiles(per_worker: DataFrame) -> DataFrame:
    """Average, upper median (no interpolation) and maximum of removed and added percent over workers that held data."""
    own = per_worker.where("before_bytes > 0").select((F.col("removed") * 100.0 / F.col("before_bytes")).alias("removed"), (F.col("added") * 100.0 / F.col("before_bytes")).alias("added"))
    out = None
    for name in ("removed", "added"):  # workers, not chunks: fleet-sized
        ranked = own.select(F.col(name).alias("v")).withColumn("i", F.row_number().over(Window.orderBy("v")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
        row = ranked.agg(F.avg("v").alias("average"), F.max(F.when(F.col("i") == F.expr("n div 2"), F.col("v"))).alias("median"), F.max("v").alias("largest")).select(F.lit(name).alias("what"), "average", "median", "largest")
        out = row if out is None else out.unionByName(row)
    return out


def load_stats(loads: DataFrame, column: str = "bytes") -> DataFrame:
    return loads.agg(F.avg(column).alias("average"), F.stddev_pop(column).alias("deviation"), F.min(column).alias("least"), F.max(column).alias("most"))


def capacity_use(used: DataFrame, stale: DataFrame, capacity: DataFrame) -> DataFrame:
    """Used, draining and free percent of the capacity; 0 without any."""
    row = used.crossJoin(stale).crossJoin(capacity)
    share = lambda x: F.when(F.col("capacity") > 0, x * 100.0 / F.col("capacity")).otherwise(F.lit(0.0))
    return row.select(share(F.col("used")).alias("used_pct"), share(F.col("stale")).alias("stale_pct"), share(F.greatest(F.lit(0), F.col("capacity") - F.col("used") - F.col("stale"))).alias("free_pct"))


def achieved_replication(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("chunk_pk").agg(F.count_distinct("worker_pk").alias("achieved"))


def min_replication_by_weight(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least achieved replication per weight; a chunk without holders counts 0."""
    own = chunks.join(achieved_replication(pairs), "chunk_pk", "left")
    return own.groupBy("weight").agg(F.min(F.coalesce("achieved", F.lit(0))).cast("bigint").alias("least"))


def invert(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("chunk_pk").agg(F.array_sort(F.collect_list("worker_pk")).alias("worker_ids"))


def compare_report(before: DataFrame, after: DataFrame, sizes: DataFrame, sample: int | None = None, unit: int = 1 << 30) -> DataFrame:
    """A line for each worker with what it held, lost, got and holds, in units of bytes; departed and new workers have one figure. sample: only
    the first workers by key."""
    own = worker_reshuffle(before, after, sizes)
    if sample is not None:
        own = own.orderBy("worker_pk").limit(sample)
    show = lambda c: F.format_string("%.2f", F.col(c) / unit)
    full = F.concat(show("before_bytes"), F.lit("GB -"), show("removed"), F.lit("GB +"), show("added"), F.lit("GB ="), show("after_bytes"), F.lit("GB"))
    line = F.when(F.col("presence") == "departed", F.concat(F.lit("-"), show("removed"), F.lit("GB"))).when(F.col("presence") == "new", F.concat(F.lit("+"), show("added"), F.lit("GB"))).otherwise(full)
    return own.select("worker_pk", line.alias("line"))
