"""Snapshot lifecycle of chunks: every step is a function from old tables to new ones.

Tables (columns as in sources.schemas): chunks, meta, workers, ideal and stale holders as (chunk_pk, worker_pk) pairs,
the diff log, the portal log, corrections. A missing meta row means pending, a null stamp that the step has not
happened, a diff without workers that the chunk left the ideal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.state import checkpoint
from . import intervals

PAIR = ["chunk_pk", "worker_pk"]


def holder_arrays(pairs: DataFrame) -> DataFrame:
    """Holders in canonical form: sorted and distinct, one row per chunk."""
    return pairs.groupBy("chunk_pk").agg(F.array_sort(F.collect_set("worker_pk")).alias("worker_ids"))


def active_workers(workers: DataFrame) -> DataFrame:
    return workers.where(F.col("inactive_since").isNull()).select("worker_pk")


# ---- admission


def candidates(chunks: DataFrame, meta: DataFrame, corrections: DataFrame) -> DataFrame:
    """Chunks that are neither admitted nor rejected, with the range of the chunk they are to replace, if any."""
    pending = chunks.join(meta, "chunk_pk", "left_anti")
    fix = corrections.where("applied_portal is null").select(F.col("new_pk").alias("chunk_pk"), "old_pk")
    old = chunks.select(F.col("chunk_pk").alias("old_pk"), F.col("first_block").alias("old_first"), F.col("last_block").alias("old_last"))
    return pending.join(fix, "chunk_pk", "left").join(old, "old_pk", "left")


def register_new_chunks(chunks: DataFrame, meta: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pending chunks with `rejected`: a replacement is judged by its range alone (it must be that of the chunk it replaces), the
    others must neither overlap a live chunk nor an accepted one of this batch."""
    own = checkpoint(candidates(chunks, meta, corrections))  # few, of joins over all chunks
    exempt = own.where("old_pk is not null").select("chunk_pk", (~((F.col("first_block") == F.col("old_first")) & (F.col("last_block") == F.col("old_last")))).alias("rejected"))
    ordinary = own.where("old_pk is null").select("dataset", "chunk_pk", "first_block", "last_block")
    live = chunks.join(meta.where(C.live_admitted()).select("chunk_pk"), "chunk_pk", "left_semi")
    hit = checkpoint(intervals.overlap_probe(ordinary, live).select("chunk_pk"))
    folded = intervals.settle(ordinary.join(hit, "chunk_pk", "left_anti"), "chunk_pk").select("chunk_pk", (~F.col("accepted")).alias("rejected"))
    return exempt.unionByName(hit.withColumn("rejected", F.lit(True))).unionByName(folded)


def chunk_status(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    state = F.when(F.col("rejected").isNull(), "pending").when(F.col("rejected"), "rejected").otherwise("admitted")
    return chunks.select("chunk_pk").join(meta.select("chunk_pk", "rejected"), "chunk_pk", "left").select("chunk_pk", state.alias("status"))


# ---- a scheduling cycle


def inactive_stale(stale: DataFrame, workers: DataFrame) -> DataFrame:
    """Stale pairs without those of inactive workers."""
    return stale.join(F.broadcast(active_workers(workers)), "worker_pk", "left_semi").select(*PAIR, "superseded_at")


def orphaned_drains(ideal: DataFrame, stale: DataFrame, workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ideal chunks none of whose holders is active take over their active drains: new ideal and new stale pairs."""
    live = F.broadcast(active_workers(workers))
    served = ideal.join(live, "worker_pk", "left_semi").select("chunk_pk").distinct()
    orphans = ideal.select("chunk_pk").distinct().join(served, "chunk_pk", "left_anti")
    moved = stale.join(live, "worker_pk", "left_semi").join(orphans, "chunk_pk", "left_semi").select(*PAIR)
    return ideal.select(*PAIR).unionByName(moved).distinct(), stale.join(moved, PAIR, "left_anti")


def tombstone_expired(meta: DataFrame, portal_log: DataFrame, stale: DataFrame, now: int, ticks: int) -> tuple[DataFrame, DataFrame]:
    """Chunks dropped from the portal at least `ticks` ago are tombstoned; their stale pairs go."""
    drop = portal_log.select(F.col("id").alias("dropped_portal"), "created_at")
    aged = meta.join(drop, "dropped_portal", "left")
    due = F.col("dropped_worker").isNull() & (F.col("created_at") <= now - ticks)
    stamped = aged.withColumn("dropped_worker", F.when(due, F.lit(now).cast("bigint")).otherwise(F.col("dropped_worker"))).select(*meta.columns)
    gone = aged.where(due).select("chunk_pk")
    return stamped, stale.join(gone, "chunk_pk", "left_anti")


def expiry_cutoff(portal_log: DataFrame, now: int, ticks: int) -> DataFrame:
    """The newest confirmed assignment that an aged portal assignment saw; 0 without one, so nothing expires."""
    return portal_log.where(F.col("created_at") <= now - ticks).agg(F.coalesce(F.max("confirmed_up_to"), F.lit(0)).alias("cutoff"))


def expire_stale(stale: DataFrame, portal_log: DataFrame, now: int, ticks: int) -> DataFrame:
    return stale.crossJoin(F.broadcast(expiry_cutoff(portal_log, now, ticks))).where("superseded_at > cutoff").drop("cutoff")


def drain_anchor(stale: DataFrame, portal_log: DataFrame) -> DataFrame:
    """First portal assignment that confirms each stale pair's end: over ends and log together, from the newest down, the smallest id so far."""
    log = portal_log.groupBy(F.col("confirmed_up_to").alias("at")).agg(F.min("id").alias("portal_id"))
    ends = stale.select(F.col("superseded_at").alias("at")).distinct().withColumn("portal_id", F.lit(None).cast("int"))
    w = Window.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row an assignment
    anchors = log.unionByName(ends).withColumn("anchor", F.min("portal_id").over(w)).groupBy("at").agg(F.min("anchor").alias("anchor"))
    return stale.join(anchors, stale["superseded_at"] == anchors["at"], "left").select(*PAIR, "anchor")


def read_placement(chunks: DataFrame, meta: DataFrame, ideal: DataFrame, stale: DataFrame) -> DataFrame:
    """Active chunks in (dataset, first block) order with what holds them now."""
    i = holder_arrays(ideal).withColumnRenamed("worker_ids", "ideal")
    s = holder_arrays(stale).withColumnRenamed("worker_ids", "stale")
    own = chunks.join(meta.where(C.active()), "chunk_pk").join(i, "chunk_pk", "left").join(s, "chunk_pk", "left")
    none = F.array().cast("array<bigint>")
    held = F.when(F.col("stale").isNull(), F.coalesce("ideal", none)).otherwise(F.array_sort(F.array_union(F.coalesce("ideal", none), "stale")))
    return own.withColumn("holders", held)


def mint_stale(before: DataFrame, after: DataFrame, stale: DataFrame, workers: DataFrame, meta: DataFrame, assignment: int) -> DataFrame:
    """Stale pairs with those that leave the ideal: of active workers, of chunks still on the portal. Pairs already stale
    keep the assignment that superseded them."""
    leaving = before.select(*PAIR).join(after, PAIR, "left_anti").join(F.broadcast(active_workers(workers)), "worker_pk", "left_semi")
    dropping = meta.where("dropped_portal is not null").select("chunk_pk")
    fresh = leaving.join(dropping, "chunk_pk", "left_anti").join(stale, PAIR, "left_anti").select(*PAIR, F.lit(assignment).cast("int").alias("superseded_at"))
    return stale.select(*PAIR, "superseded_at").unionByName(fresh)


def evict_pairs(stale: DataFrame, evicted: DataFrame) -> DataFrame:
    return stale.join(evicted, PAIR, "left_anti")


def diff(before: DataFrame, after: DataFrame, assignment: int | None = None) -> DataFrame:
    """Changed chunks with their new holders; an empty array for those that left."""
    a = holder_arrays(before).withColumnRenamed("worker_ids", "old_ids")
    b = holder_arrays(after)
    changed = a.join(b, "chunk_pk", "full_outer").where(~F.col("old_ids").eqNullSafe(F.col("worker_ids")))
    out = changed.select("chunk_pk", F.coalesce("worker_ids", F.array().cast("array<bigint>")).alias("worker_ids"))
    return out if assignment is None else out.select(F.lit(assignment).cast("int").alias("assignment_id"), "chunk_pk", "worker_ids")


def cancel_flipflop(stale: DataFrame, after: DataFrame) -> DataFrame:
    """Stale pairs that the new ideal takes back are no longer stale."""
    return stale.join(after, PAIR, "left_anti")


def stamp_first_applied(meta: DataFrame, after: DataFrame, assignment: int) -> DataFrame:
    """First appearance in an ideal, never reset, not for chunks marked for removal."""
    here = after.select("chunk_pk").distinct().withColumn("_here", F.lit(True))
    stamp = F.when(F.col("_here") & F.col("marked").isNull(), F.lit(assignment).cast("int"))
    return meta.join(here, "chunk_pk", "left").withColumn("applied_worker", F.coalesce("applied_worker", stamp)).select(*meta.columns)


def apply_deltas(before: DataFrame, after: DataFrame, stale: DataFrame, evicted: DataFrame, workers: DataFrame, meta: DataFrame, assignment: int) -> dict[str, DataFrame]:
    """The six sections of a swap, in their order: mint, evict, diff, cancel, stamp, swap."""
    drained = evict_pairs(mint_stale(before, after, stale, workers, meta, assignment), evicted)
    return {
        "difflog": diff(before, after, assignment),
        "stale": cancel_flipflop(drained, after),
        "meta": stamp_first_applied(meta, after, assignment),
        "ideal": after,
    }


# ---- confirmation and visibility


def confirmation_watermark(confirmed: DataFrame) -> DataFrame:
    return confirmed.agg(F.coalesce(F.max("id"), F.lit(0)).alias("watermark"))


def replay(routing: DataFrame, difflog: DataFrame, previous: int, target: int) -> DataFrame:
    """Routing (chunk_pk, worker_ids) after the diffs in (previous, target]: the newest of each chunk wins, an empty one
    deletes; nothing happens for a target not beyond `previous`."""
    newest = difflog.where((F.col("assignment_id") > previous) & (F.col("assignment_id") <= target))
    newest = newest.groupBy("chunk_pk").agg(F.max_by("worker_ids", "assignment_id").alias("worker_ids"))
    return routing.join(newest, "chunk_pk", "left_anti").unionByName(newest.where(F.size("worker_ids") > 0))


def promote(meta: DataFrame, corrections: DataFrame, watermark: int, portal: int) -> DataFrame:
    """Confirmed, unmarked, admitted chunks that no pending correction holds back enter the portal."""
    held = corrections.where("applied_portal is null").select(F.col("new_pk").alias("chunk_pk")).distinct().withColumn("_held", F.lit(True))
    ok = (
        F.col("applied_portal").isNull() & C.confirmed_by(watermark) & ~F.col("rejected") & F.col("marked").isNull() & F.col("dropped_worker").isNull() & F.col("_held").isNull()
    )
    own = meta.join(held, "chunk_pk", "left")
    return own.withColumn("applied_portal", F.when(ok, F.lit(portal).cast("int")).otherwise(F.col("applied_portal"))).select(*meta.columns)


def evict_overlaps(meta: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of visible chunks that overlap, the losers of the fold leave the portal again: new meta, held back per dataset."""
    visible = chunks.join(meta.where(C.portal_visible()).select("chunk_pk"), "chunk_pk", "left_semi").select("dataset", "chunk_pk", "first_block", "last_block")
    losers = intervals.portal_overlap_losers(visible, "chunk_pk")
    lost = losers.select("chunk_pk").withColumn("_lost", F.lit(True))
    out = meta.join(lost, "chunk_pk", "left").withColumn("applied_portal", F.when(F.col("_lost").isNull(), F.col("applied_portal"))).select(*meta.columns)
    return out, losers.groupBy("dataset").agg(F.count("*").alias("held_back"))


def drop_marked(meta: DataFrame, portal: int) -> DataFrame:
    due = F.col("marked").isNotNull() & C.portal_visible()
    return meta.withColumn("dropped_portal", F.when(due, F.lit(portal).cast("int")).otherwise(F.col("dropped_portal")))


def mark_for_removal(meta: DataFrame, chunks: DataFrame, now: int) -> DataFrame:
    mark = chunks.select("chunk_pk").withColumn("_mark", F.lit(now).cast("bigint"))
    return meta.join(mark, "chunk_pk", "left").withColumn("marked", F.coalesce("marked", "_mark")).select(*meta.columns)


def ready_corrections(corrections: DataFrame, meta: DataFrame, watermark: int, rounds: int = 64) -> DataFrame:
    """Pending corrections that fire now. One fires if its replacement is confirmed and no unfired one produces its old
    chunk; chains are walked by pointer doubling, so `rounds` bounds their length by 2^rounds."""
    pending = corrections.where("applied_portal is null").join(meta.select(F.col("chunk_pk").alias("new_pk"), F.col("applied_worker"), F.col("rejected")), "new_pk", "left")
    state = pending.select("old_pk", "new_pk", F.coalesce((F.col("applied_worker") <= watermark) & ~F.col("rejected"), F.lit(False)).alias("good"))
    # follow each correction to the one that produces its old chunk; all on the way must be good
    node = state.select("old_pk", "new_pk", "good", F.col("old_pk").alias("up"))
    for _ in range(rounds):
        above = node.select(F.col("new_pk").alias("up"), F.col("good").alias("up_good"), F.col("up").alias("up_up"))
        step = node.join(above, "up", "left").select(
            "old_pk", "new_pk", (F.col("good") & F.coalesce("up_good", F.lit(True))).alias("good"), F.coalesce("up_up", F.lit(None)).alias("up")
        )
        node = checkpoint(step)
        if node.where("up is not null").isEmpty():
            break
    return node.where("good").select("old_pk", "new_pk")


def apply_corrections(corrections: DataFrame, meta: DataFrame, watermark: int, portal: int, now: int) -> tuple[DataFrame, DataFrame]:
    """Fired corrections are stamped and their old chunks marked for removal."""
    fired = ready_corrections(corrections, meta, watermark)
    stamped = corrections.join(fired.select("old_pk").withColumn("_f", F.lit(portal).cast("int")), "old_pk", "left").withColumn("applied_portal", F.coalesce("applied_portal", "_f")).select(*corrections.columns)
    return stamped, mark_for_removal(meta, fired.select(F.col("old_pk").alias("chunk_pk")), now)


def register_corrections(new: DataFrame, corrections: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Why each new correction (old_pk, first_block, last_block) is refused, or null: old chunk unknown, not live, already being
    replaced, replaced twice in the batch, or the range changes."""
    old = chunks.select(F.col("chunk_pk").alias("old_pk"), F.col("first_block").alias("of"), F.col("last_block").alias("ol"), F.lit(True).alias("known"))
    live = meta.where(C.live_admitted()).select(F.col("chunk_pk").alias("old_pk"), F.lit(True).alias("live"))
    taken = corrections.select("old_pk").distinct().withColumn("taken", F.lit(True))
    twice = new.groupBy("old_pk").agg((F.count("*") > 1).alias("twice"))
    own = new.join(old, "old_pk", "left").join(live, "old_pk", "left").join(taken, "old_pk", "left").join(twice, "old_pk")
    same = F.col("of").eqNullSafe(F.col("first_block")) & F.col("ol").eqNullSafe(F.col("last_block"))
    why = F.when(F.col("known").isNull(), "unknown chunk").when(F.col("taken"), "already replaced").when(F.col("twice"), "replaced twice").when(F.col("live").isNull(), "not live").when(~same, "range changes")
    return own.select("old_pk", why.alias("refused"))


def visible_routing(routing: DataFrame, meta: DataFrame) -> DataFrame:
    return routing.join(meta.where(C.portal_visible()).select("chunk_pk"), "chunk_pk", "left_semi")


def servable_holders(ideal: DataFrame, stale: DataFrame, meta: DataFrame) -> DataFrame:
    """What workers hold: ideal and draining pairs of chunks that are not tombstoned."""
    pairs = ideal.select(*PAIR).unionByName(stale.select(*PAIR)).distinct()
    return pairs.join(meta.where(C.tombstoned()).select("chunk_pk"), "chunk_pk", "left_anti")


def rejected_by_dataset(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    return chunks.join(verdicts.where("rejected"), "chunk_pk").groupBy("dataset").agg(F.count("*").alias("rejected"))


def overlapping_incoming(new: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Incoming chunks that share a block with a claimant of another id: their place in the batch (idx) and the smallest claimant's id.
    Claimants are pending chunks, which have no meta row, and live admitted ones; rejected, marked and dropped chunks give
    their range free. new (idx, dataset, chunk_id, first_block, last_block)."""
    gone = meta.where(~C.live_admitted()).select("chunk_pk")
    claim = chunks.join(gone, "chunk_pk", "left_anti")
    incoming = new.select("dataset", F.struct("idx", "chunk_id").alias("id"), "first_block", "last_block")
    met = intervals.overlap_join(incoming, claim.select("dataset", F.col("chunk_id").alias("id"), "first_block", "last_block"))
    other = met.where(F.col("left_id.chunk_id") != F.col("right_id"))
    return other.groupBy(F.col("left_id.idx").alias("idx"), F.col("left_id.chunk_id").alias("chunk_id")).agg(F.min("right_id").alias("claimant"))


def insert_chunks(new: DataFrame, chunks: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """An ingest request: duplicates inside the batch, ranges that overlap inside it or with a claimant (see
    overlapping_incoming), rows to insert, ids that were there already. new and chunks
    (dataset, chunk_id, first_block, last_block, ...); the batch's order is that of idx, else of its ids."""
    key = ["dataset", "chunk_id"]
    placed = new if "idx" in new.columns else new.withColumn("idx", F.row_number().over(Window.orderBy(*key)) - 1)  # a request's rows
    hit = overlapping_incoming(placed, chunks, meta)
    return {
        "duplicate_in_batch": new.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key),
        "overlap_in_batch": intervals.running_max_reject(new, "chunk_id"),
        "overlap_stored": placed.join(hit.select("idx", "claimant"), "idx").select(*key, "first_block", "last_block", "idx", "claimant"),
        "inserted": new.join(chunks.select(*key), key, "left_anti"),
        "duplicates": new.join(chunks.select(*key), key, "left_semi").select(*key),
    }
