"""Cycles end to end, with the invariants after every step."""

import json

from lakekeel.operators import invariants, lifecycle
from lakekeel.plans import cycle
from lakekeel.sources import schemas as S


def start(spark, n_chunks=40, n_workers=6):
    empty = lambda schema: spark.createDataFrame([], schema)
    chunks = spark.createDataFrame([(i, f"d{i % 2}", f"{i:010d}", i * 10, i * 10 + 9, 5 + i % 7, 1 + i % 2) for i in range(n_chunks)], "chunk_pk bigint, dataset string, chunk_id string, first_block bigint, last_block bigint, size bigint, weight int")
    workers = spark.createDataFrame([(w, f"peer{w}", "2.0.0", None) for w in range(n_workers)], S.WORKER)
    return cycle.State(chunks, empty(S.META), workers, empty(S.HOLDERS), empty(S.STALE), empty(S.DIFF), empty(S.PORTAL), empty(S.CORRECTION), empty("chunk_pk bigint, worker_ids array<bigint>"))


def check(state, copies=2):
    held = state.ideal.groupBy("chunk_pk").count()
    assert held.count() == 40 and held.where(f"count <> {copies}").count() == 0
    assert invariants.duplicate_replicas(state.ideal).count() == 0
    visible = state.chunks.join(state.meta.where("applied_portal is not null and dropped_portal is null").select("chunk_pk"), "chunk_pk")
    assert invariants.visible_overlaps(visible).count() == 0
    assert invariants.empty_routing(state.routing).count() == 0
    held = lifecycle.servable_holders(state.ideal, state.stale, state.meta)
    routing = lifecycle.visible_routing(state.routing, state.meta)
    assert invariants.uncovered(routing, held, lifecycle.active_workers(state.workers)).count() == 0


def test_walk(spark):
    args = {"ticks": 20, "copies": 2, "rings": 40}
    state = cycle.register(start(spark))
    state, why = cycle.scheduling_cycle(state, 10, **args)
    assert why is None and state.published == 1
    state = cycle.visibility_cycle(cycle.confirm(state, 1), 10)
    check(state)
    read = spark.createDataFrame([(7, "d0", True), (6, "d1", False)], "schema_id int, dataset string, current boolean")
    view = cycle.portal_view(state, read)
    assert view["routing"].count() == 40 and {r["dataset"]: r["read_schema_id"] for r in view["read_schemas"].collect()} == {"d0": 7, "d1": None}
    assert state.routing.count() == 40 and state.meta.where("applied_portal = 1").count() == 40
    # a worker leaves, one comes
    active = spark.createDataFrame([(f"peer{w}", "2.0.0") for w in (0, 1, 2, 3, 4, 9)], "peer_id string, version string")
    state = cycle.update_workers(state, active, 20, 10)
    after, why = cycle.scheduling_cycle(state, 30, **args)
    assert why is None
    check(after)
    assert cycle.step_report(state, after).first()["shuffled_copies"] >= 0
    after = cycle.confirm(after, 2)
    assert cycle.confirm(after, 1) is after
    after = cycle.visibility_cycle(after, 60)
    later, why = cycle.scheduling_cycle(after, 90, **args)
    assert why is None
    check(later)
    # too small a fleet leaves what housekeeping did
    short, why = cycle.scheduling_cycle(later, 95, ticks=20, copies=9, rings=40)
    assert why and short.published == later.published


def test_lowering(spark):
    from lakekeel.operators import schema_registry

    schema = json.dumps({"tables": {n: {"fields": ["n"], "default_fields": []} for n in ("b", "a", "c")}})
    schemas = spark.createDataFrame([(1, schema)], "schema_id int, document string")
    rows = [(0, 1, None), (1, 1, ["c", "a"]), (2, 1, []), (3, 1, ["a", "b", "c"]), (4, 1, ["x"]), (5, 2, None)]
    new = spark.createDataFrame([(i, k, t, 0, 9, 1) for i, k, t in rows], "idx int, schema_id int, tables array<string>, first_block bigint, last_block bigint, size bigint")
    got = {r["idx"]: (r["tables_present"], r["refused"]) for r in schema_registry.lower_chunks(new, schemas).collect()}
    assert got == {0: (None, None), 1: ("101", None), 2: ("000", None), 3: (None, None), 4: (None, "unknown table"), 5: (None, "unknown schema")}
