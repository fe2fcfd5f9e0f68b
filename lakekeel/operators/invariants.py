"""Invariants as queries: each returns the rows that break it, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import checkpoint
from . import intervals

PAIR = ["chunk_pk", "worker_pk"]


def overcommitted(ideal: DataFrame, stale: DataFrame, sizes: DataFrame, capacity: DataFrame) -> DataFrame:
    """Workers whose ideal and draining copies exceed the capacity."""
    pairs = ideal.select(*PAIR).unionByName(stale.select(*PAIR)).distinct()
    load = pairs.join(sizes.select("chunk_pk", "size"), "chunk_pk").groupBy("worker_pk").agg(F.sum("size").alias("bytes"))
    return load.crossJoin(F.broadcast(capacity)).where("bytes > capacity").select("worker_pk", "bytes")


def retention_broken(before: DataFrame, after: DataFrame, min_r: int) -> DataFrame:
    """New chunks with some, but fewer than the least replicas; known chunks that keep fewer than the least, or all they had."""
    a = before.groupBy("chunk_pk").agg(F.count("*").alias("held"))
    b = after.groupBy("chunk_pk").agg(F.count("*").alias("now"))
    kept = before.join(after, PAIR).groupBy("chunk_pk").agg(F.count("*").alias("kept"))
    own = a.join(b, "chunk_pk", "full_outer").join(kept, "chunk_pk", "left")
    held, now, keep = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("held", "now", "kept"))
    return own.select("chunk_pk", held.alias("held"), now.alias("now"), keep.alias("kept")).where(
        ((F.col("held") == 0) & (F.col("now") > 0) & (F.col("now") < min_r)) | ((F.col("held") > 0) & (F.col("kept") < F.least(F.lit(min_r), F.col("held"))))
    )


def visible_overlaps(visible: DataFrame) -> DataFrame:
    """Visible chunks that begin inside an earlier one of their dataset."""
    return intervals.running_end(visible, "chunk_pk").where("first_block <= _end").select("dataset", "chunk_pk")


def empty_routing(routing: DataFrame, *keys: str) -> DataFrame:
    return routing.where(F.size("worker_ids") == 0).select(*(keys or ("chunk_pk",)))


def duplicate_replicas(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.count("*").alias("copies")).where("copies > 1")


def routed_not_held(routing: DataFrame, held: DataFrame, active: DataFrame) -> DataFrame:
    """Routed (chunk, worker) pairs of active workers that do not hold the chunk."""
    pairs = routing.select("chunk_pk", F.explode("worker_ids").alias("worker_pk")).join(F.broadcast(active), "worker_pk", "left_semi")
    return pairs.select(*PAIR).join(held, PAIR, "left_anti")


def uncovered(routing: DataFrame, held: DataFrame, active: DataFrame) -> DataFrame:
    """Routed chunks that no active holder lists."""
    served = held.join(F.broadcast(active), "worker_pk", "left_semi").select("chunk_pk").distinct()
    return routing.select("chunk_pk").join(served, "chunk_pk", "left_anti")


def unresolved_schemas(named: DataFrame, schemas: DataFrame) -> DataFrame:
    return named.join(schemas, "schema_id", "left_anti")


def _short(chunks: DataFrame, pairs: DataFrame, min_r: int) -> DataFrame:
    have = pairs.groupBy("chunk_pk").agg(F.count_distinct("worker_pk").alias("have"))
    own = chunks.select("chunk_pk", "size").join(have, "chunk_pk", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return own.where(F.col("have") < min_r)


def _free(chunks: DataFrame, pairs: DataFrame, workers: DataFrame, capacity: DataFrame) -> DataFrame:
    load = pairs.join(chunks.select("chunk_pk", "size"), "chunk_pk").groupBy("worker_pk").agg(F.sum("size").alias("used"))
    own = workers.where("inactive_since is null").select("worker_pk").join(load, "worker_pk", "left").crossJoin(F.broadcast(capacity))
    return own.select("worker_pk", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("room"))


#: Bytes of a bin in which sizes and rooms are ranked.
BIN_BYTES = 1 << 12


def _fits(sizes: DataFrame, room: DataFrame) -> DataFrame:
    """Rows (size, fit): the number of rooms that are no smaller than each size. Sizes and rooms are ranked together, by bins; what bins hand on is a row
    each, so that no row meets all workers."""
    both = sizes.select(F.col("size").alias("value"), F.lit(0).alias("n")).distinct().unionByName(room.groupBy(F.col("room").alias("value")).agg(F.count("*").alias("n")))
    own = checkpoint(both.groupBy("value").agg(F.sum("n").alias("n")).withColumn("_bin", F.expr(f"value div {BIN_BYTES}")))
    above = F.sum("sum").over(Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    carry = own.groupBy("_bin").agg(F.sum("n").alias("sum")).select("_bin", above.alias("_carry"))
    here = F.sum("n").over(Window.partitionBy("_bin").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    return own.join(carry, "_bin").select(F.col("value").alias("size"), (here + F.coalesce("_carry", F.lit(0))).alias("fit"))


def _with_hosts(short: DataFrame, pairs: DataFrame, room: DataFrame) -> DataFrame:
    """Short chunks with the number of workers that have room for a copy and hold none. Workers with room are counted by the rank of the chunk's size among
    all rooms; those that hold the chunk are counted apart, so no pair of chunk and worker is made. short is used several times."""
    holding = short.select("chunk_pk", "size").join(pairs.select(*PAIR).distinct(), "chunk_pk").join(F.broadcast(room), "worker_pk").where("room >= size").groupBy("chunk_pk").agg(F.count("*").alias("holding"))
    own = short.join(_fits(short, room), "size", "left").join(holding, "chunk_pk", "left")
    return own.withColumn("hosts", (F.coalesce("fit", F.lit(0)) - F.coalesce("holding", F.lit(0))).cast("bigint")).drop("fit")


def feasible_but_short(chunks: DataFrame, pairs: DataFrame, workers: DataFrame, capacity: DataFrame, min_r: int) -> DataFrame:
    """Chunks below the least replication although enough active workers without them have room."""
    own = _with_hosts(checkpoint(_short(chunks, pairs, min_r)), pairs, checkpoint(_free(chunks, pairs, workers, capacity)))
    return own.where(F.col("have") + F.col("hosts") >= min_r).select("chunk_pk", F.col("have").cast("bigint").alias("have"), F.col("hosts").alias("roomy"))


def bonus_over_floor(chunks: DataFrame, pairs: DataFrame, workers: DataFrame, capacity: DataFrame, min_r: int) -> DataFrame:
    """Chunks below the least replication although enough active workers without them have room, or would have it
    without bonus copies of other chunks. A chunk's bonus copies are those beyond the least replication; for a chunk that needs one copy any of them
    may go, for one that needs several those of each chunk's first workers, so that no chunk falls below its own floor."""
    have = pairs.groupBy("chunk_pk").agg(F.count_distinct("worker_pk").alias("have"))
    rank = F.row_number().over(Window.partitionBy("chunk_pk").orderBy("worker_pk"))
    bonus = pairs.select(*PAIR).distinct().join(have.where(F.col("have") > min_r), "chunk_pk").join(chunks.select("chunk_pk", "size"), "chunk_pk").withColumn("rank", rank)
    counted = F.when(F.col("rank") <= F.col("have") - min_r, F.col("size")).otherwise(0)
    bonus = bonus.groupBy("worker_pk").agg(F.sum("size").alias("any"), F.sum(counted).alias("first"))
    free = checkpoint(_free(chunks, pairs, workers, capacity).join(bonus, "worker_pk", "left"))
    room = {k: free.select("worker_pk", (F.greatest("room", F.lit(0)) + F.coalesce(k, F.lit(0))).alias("room")) for k in ("any", "first")}
    short = checkpoint(_short(chunks, pairs, min_r))
    one = _with_hosts(short.where(F.col("have") == min_r - 1), pairs, room["any"])
    more = _with_hosts(short.where(F.col("have") < min_r - 1), pairs, room["first"])
    return one.unionByName(more).where(F.col("have") + F.col("hosts") >= min_r).select("chunk_pk", F.col("have").cast("bigint").alias("have"), "hosts")
