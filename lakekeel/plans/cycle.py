"""Whole cycles over a state of tables: scheduling, confirmation, visibility. Each gives a new state; one writer."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fleet, lifecycle, movement, schema_registry
from ..operators import rings as ring_tables
from ..operators.weights import NotEnoughCapacity
from .state import checkpoint


@dataclass(frozen=True)
class State:
    """chunks (chunk_pk, dataset, chunk_id, first_block, last_block, size, weight), and the lifecycle tables."""

    chunks: DataFrame
    meta: DataFrame
    workers: DataFrame
    ideal: DataFrame
    stale: DataFrame
    difflog: DataFrame
    portal_log: DataFrame
    corrections: DataFrame
    routing: DataFrame
    published: int = 0
    confirmed: int = 0
    portal: int = 0

    def saved(self) -> State:
        """All tables written and read back."""
        return replace(self, **{k: checkpoint(v) for k, v in vars(self).items() if isinstance(v, DataFrame)})


def register(state: State) -> State:
    """Pending chunks become admitted or rejected."""
    verdicts = lifecycle.register_new_chunks(state.chunks, state.meta, state.corrections)
    none = [F.lit(None).cast(t).alias(c) for c, t in state.meta.dtypes if c not in ("chunk_pk", "rejected")]
    return replace(state, meta=state.meta.unionByName(verdicts.select("chunk_pk", "rejected", *none)))


def housekeeping(state: State, now: int, ticks: int) -> State:
    """What a cycle keeps even if its placement fails: inactive drains go, orphaned chunks take over drains, aged drops are
    tombstoned, confirmed drains expire."""
    stale = lifecycle.inactive_stale(state.stale, state.workers)
    ideal, stale = lifecycle.orphaned_drains(state.ideal, stale, state.workers)
    meta, stale = lifecycle.tombstone_expired(state.meta, state.portal_log, stale, now, ticks)
    return replace(state, meta=meta, ideal=ideal, stale=lifecycle.expire_stale(stale, state.portal_log, now, ticks)).saved()


def schedule(state: State, copies: int, rings: int) -> State:
    """Active chunks go to the next active workers of their rings, `copies` of each, and the result is swapped in. Raises NotEnoughCapacity if there are fewer workers
    and leaves the state alone."""
    workers = state.workers.where("inactive_since is null")
    if workers.count() < copies:
        raise NotEnoughCapacity(f"fewer than {copies} active workers")
    active = state.chunks.join(state.meta.where(C.active()).select("chunk_pk"), "chunk_pk", "left_semi")
    keys = ring_tables.with_ring(ring_tables.replica_hashes(active, F.lit(1)), rings).withColumns({"minimum": F.lit(None).cast("string"), "copies": F.lit(copies)})
    found = ring_tables.successors(keys, ring_tables.build_rings(workers, rings), workers, copies)
    after = checkpoint(found.select("chunk_pk", F.explode("worker_ids").alias("worker_pk")))
    number = state.published + 1
    new = lifecycle.apply_deltas(state.ideal, after, state.stale, after.limit(0), state.workers, state.meta, number)
    return replace(state, ideal=new["ideal"], stale=new["stale"], meta=new["meta"], difflog=state.difflog.unionByName(new["difflog"]), published=number).saved()


def scheduling_cycle(state: State, now: int, ticks: int, copies: int, rings: int) -> tuple[State, str | None]:
    """The new state and, if the fleet is too small, why nothing was placed."""
    kept = housekeeping(state, now, ticks)
    try:
        return schedule(kept, copies, rings), None
    except NotEnoughCapacity as e:
        return kept, str(e)


def confirm(state: State, target: int) -> State:
    """Replay diffs up to a confirmed assignment; an older target changes nothing."""
    if target <= state.confirmed:
        return state
    routing = lifecycle.replay(state.routing, state.difflog, state.confirmed, target)
    return replace(state, routing=routing, difflog=state.difflog.where(F.col("assignment_id") > target), confirmed=target).saved()


def visibility_cycle(state: State, now: int) -> State:
    """A new portal assignment: corrections, promotion, drops, overlaps."""
    number = state.portal + 1
    row = state.chunks.sparkSession.createDataFrame([(number, now, state.confirmed)], state.portal_log.schema)
    corrections, meta = lifecycle.apply_corrections(state.corrections, state.meta, state.confirmed, number, now)
    meta = lifecycle.promote(checkpoint(meta), corrections, state.confirmed, number)
    meta, _ = lifecycle.evict_overlaps(lifecycle.drop_marked(meta, number), state.chunks)
    return replace(state, meta=meta, corrections=corrections, portal_log=state.portal_log.unionByName(row), portal=number).saved()


def portal_view(state: State, read: DataFrame) -> dict[str, DataFrame]:
    """What a visibility cycle publishes: the visible routing, and the current read schema of each dataset that it names (null if none was promoted).
    read as in schema_registry.read_schema_ids."""
    routing = lifecycle.visible_routing(state.routing, state.meta)
    named = state.chunks.join(routing.select("chunk_pk"), "chunk_pk", "left_semi").select("dataset").distinct()
    return {"routing": routing, "read_schemas": schema_registry.read_schema_ids(named, read)}


def update_workers(state: State, active: DataFrame, now: int, gc_ticks: int) -> State:
    merged = fleet.worker_set(state.workers, active, now)
    top = state.workers.agg(F.coalesce(F.max("worker_pk"), F.lit(0))).first()[0]
    fresh = F.lit(top) + F.dense_rank().over(_by_peer())
    numbered = merged.where("worker_pk is null").withColumn("worker_pk", fresh.cast("bigint")).unionByName(merged.where("worker_pk is not null"))
    workers, stale = fleet.gc_workers(numbered.select(*state.workers.columns), state.stale, now, gc_ticks)
    return replace(state, workers=workers, stale=stale).saved()


def _by_peer():
    from pyspark.sql import Window

    return Window.orderBy("peer_id")


def step_report(before: State, after: State) -> DataFrame:
    """What a step moved."""
    return movement.shuffle_share(movement.data_movement(before.ideal, after.ideal, after.chunks, before.stale, after.stale))
