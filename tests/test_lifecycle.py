"""Lifecycle steps in small states."""

from lakekeel.operators import invariants, lifecycle, movement
from lakekeel.streaming import flows


def pairs(spark, rows):
    return spark.createDataFrame(rows, "chunk_pk bigint, worker_pk bigint")


def stale(spark, rows):
    return spark.createDataFrame(rows, "chunk_pk bigint, worker_pk bigint, superseded_at int")


META = "chunk_pk bigint, rejected boolean, applied_worker int, applied_portal int, marked bigint, dropped_portal int, dropped_worker bigint"


def meta(spark, *rows):
    return spark.createDataFrame(list(rows), META)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_apply_deltas_order(spark):
    before, after = pairs(spark, [(1, 10), (1, 11), (2, 10), (3, 12)]), pairs(spark, [(1, 11), (1, 12), (2, 13)])
    workers = spark.createDataFrame([(w, None if w != 12 else 5) for w in (10, 11, 12, 13)], "worker_pk bigint, inactive_since bigint")
    m = meta(spark, (1, False, None, None, None, None, None), (2, False, 4, None, None, None, None), (3, False, 1, 1, 7, 2, None))
    old = stale(spark, [(2, 13, 3), (1, 10, 2)])
    got = lifecycle.apply_deltas(before, after, old, pairs(spark, [(2, 10)]), workers, m, 9)
    # (1,10) keeps its first end; (2,10) was evicted; (2,13) is back in the ideal; (3,12) is of an inactive worker
    assert as_set(got["stale"]) == {(1, 10, 2)}
    assert {(r["chunk_pk"], tuple(r["worker_ids"])) for r in got["difflog"].collect()} == {(1, (11, 12)), (2, (13,)), (3, ())}
    assert {r["chunk_pk"]: r["applied_worker"] for r in got["meta"].collect()} == {1: 9, 2: 4, 3: 1}


def test_replay_is_half_open_and_idempotent(spark):
    routing = spark.createDataFrame([(1, [1]), (2, [2])], "chunk_pk bigint, worker_ids array<bigint>")
    log = spark.createDataFrame([(1, 1, [9]), (2, 1, [5]), (3, 2, []), (4, 3, [7])], "assignment_id int, chunk_pk bigint, worker_ids array<bigint>")
    got = {r["chunk_pk"]: r["worker_ids"] for r in lifecycle.replay(routing, log, 1, 3).collect()}
    assert got == {1: [5]}
    assert {r["chunk_pk"] for r in lifecycle.replay(routing, log, 3, 3).collect()} == {1, 2}


def test_expiry_without_an_aged_portal_keeps_all(spark):
    log = spark.createDataFrame([(1, 100, 9)], "id int, created_at bigint, confirmed_up_to int")
    assert lifecycle.expire_stale(stale(spark, [(1, 1, 1)]), log, 60, 20).count() == 1
    assert lifecycle.expire_stale(stale(spark, [(1, 1, 9), (1, 2, 10)]), log, 120, 20).collect()[0]["superseded_at"] == 10


def test_correction_chain_fires_from_its_root(spark):
    fix = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, None), (7, 8, None)], "old_pk bigint, new_pk bigint, applied_portal int")
    m = meta(spark, *[(k, False, 1, None, None, None, None) for k in (1, 2, 4, 8)], (3, False, 9, None, None, None, None))
    assert as_set(lifecycle.ready_corrections(fix, m, 4)) == {(1, 2), (7, 8)}  # 2->3 is not confirmed, so 3->4 waits
    m2 = meta(spark, *[(k, False, 1, None, None, None, None) for k in (1, 2, 3, 4)])
    assert as_set(lifecycle.ready_corrections(fix, m2, 4)) == {(1, 2), (2, 3), (3, 4)}


def test_promotion_waits_for_pending_corrections(spark):
    fix = spark.createDataFrame([(1, 2, None)], "old_pk bigint, new_pk bigint, applied_portal int")
    m = meta(spark, (2, False, 1, None, None, None, None), (3, False, 1, None, None, None, None), (4, False, 9, None, None, None, None), (5, True, 1, None, None, None, None))
    got = {r["chunk_pk"]: r["applied_portal"] for r in lifecycle.promote(m, fix, 4, 7).collect()}
    assert got == {2: None, 3: 7, 4: None, 5: None}


def test_evict_overlaps(spark):
    chunks = spark.createDataFrame([(1, "d", 0, 10), (2, "d", 5, 15), (3, "d", 11, 20)], "chunk_pk bigint, dataset string, first_block bigint, last_block bigint")
    m = meta(spark, *[(k, False, 1, 1, None, None, None) for k in (1, 2, 3)])
    out, held = lifecycle.evict_overlaps(m, chunks)
    assert {r["chunk_pk"]: r["applied_portal"] for r in out.collect()} == {1: 1, 2: None, 3: 1}
    assert as_set(held) == {("d", 1)}
    visible = chunks.join(out.where("applied_portal is not null").select("chunk_pk"), "chunk_pk")
    assert invariants.visible_overlaps(visible).count() == 0


def test_admission(spark):
    chunks = spark.createDataFrame([(1, "d", 0, 9), (2, "d", 5, 12), (3, "d", 20, 29), (4, "d", 25, 27), (5, "d", 0, 9), (6, "d", 40, 41)], "chunk_pk bigint, dataset string, first_block bigint, last_block bigint")
    m = meta(spark, (1, False, 1, 1, None, None, None))
    fix = spark.createDataFrame([(1, 5, None), (1, 6, None)], "old_pk bigint, new_pk bigint, applied_portal int")
    got = {r["chunk_pk"]: r["rejected"] for r in lifecycle.register_new_chunks(chunks, m, fix).collect()}
    assert got == {2: True, 3: False, 4: True, 5: False, 6: True}


def test_insert_chunks(spark):
    cols = "chunk_pk bigint, dataset string, chunk_id string, first_block bigint, last_block bigint"
    stored = spark.createDataFrame([(1, "d", "a", 0, 9), (2, "d", "b", 50, 59)], cols)
    new = spark.createDataFrame([(None, "d", "a", 0, 9), (None, "d", "c", 8, 12), (None, "d", "e", 70, 75), (None, "d", "f", 74, 80)], cols).drop("chunk_pk")
    got = lifecycle.insert_chunks(new, stored, meta(spark, (2, True, None, None, None, None, None)))
    assert {r["chunk_id"] for r in got["overlap_stored"].collect()} == {"c"}
    assert {r["chunk_id"] for r in got["overlap_in_batch"].collect()} == {"c", "f"}
    assert {r["chunk_id"] for r in got["duplicates"].collect()} == {"a"}
    assert {r["chunk_id"] for r in got["inserted"].collect()} == {"c", "e", "f"}
    assert {r["claimant"] for r in got["overlap_stored"].collect()} == {"a"}
    # a tombstoned, marked or portal-dropped chunk gives its range free; a pending and a live one do not
    for row, hit in (((1, False, 1, 1, None, None, 30), False), ((1, False, 1, 1, 20, None, None), False), ((1, False, 1, 1, 20, 3, None), False), ((1, False, 1, 1, None, None, None), True)):
        assert lifecycle.insert_chunks(new, stored, meta(spark, (2, True, None, None, None, None, None), row))["overlap_stored"].isEmpty() != hit


def test_movement_counts(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 100), (3, 7)], "chunk_pk bigint, size bigint")
    before, after = pairs(spark, [(1, 1), (1, 2), (2, 1), (3, 1)]), pairs(spark, [(1, 1), (1, 3), (2, 1), (2, 2), (4, 1)])
    row = movement.data_movement(before, after, sizes).first()
    assert (row["shuffled_chunks"], row["shuffled_copies"], row["shuffled_bytes"]) == (1, 1, 10)
    assert (row["increased_bytes"], row["shed_bytes"], row["freed_bytes"], row["new_bytes"]) == (100, 0, 17, 0)
    # a drain that keeps its bytes is no loss on disk
    row = movement.data_movement(before, after, sizes, None, pairs(spark, [(1, 2)])).first()
    assert (row["shuffled_bytes"], row["freed_bytes"]) == (10, 7)


def test_upper_median(spark):
    rows = spark.createDataFrame([(i, 100, r, 0) for i, r in enumerate((1, 2, 3, 40))], "worker_pk bigint, before_bytes bigint, removed bigint, added bigint")
    got = {r["what"]: r["median"] for r in movement.reshuffle_percentiles(rows).collect()}
    assert got == {"removed": 3.0, "added": 0.0}


def test_stream_steps(spark):
    echo = lambda *ids: spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "worker int, applied_id int")
    mark = flows.ConfirmationWatermark(10, 75)
    for k, ids in enumerate([(3, 3, 3, 1), (1, 1, 1, 1), (5, 5, 4, 99)]):
        mark(echo(*ids), k)
    assert mark.value == 4
    routing = spark.createDataFrame([(1, [1])], "chunk_pk bigint, worker_ids array<bigint>")
    batch = spark.createDataFrame([(1, 1, [2]), (2, 2, [3])], "assignment_id int, chunk_pk bigint, worker_ids array<bigint>")
    replay = flows.DiffReplay(routing)
    replay(batch, 0)
    replay(batch, 0)
    assert {r["chunk_pk"]: r["worker_ids"] for r in replay.routing.collect()} == {1: [2], 2: [3]}
    drain = flows.DrainTimer(stale(spark, [(1, 1, 1), (1, 2, 3)]), 20, lambda b: 60)
    drain(spark.createDataFrame([(1, 30, 2)], "id int, created_at bigint, confirmed_up_to int"), 0)
    assert drain.stale.count() == 1


def test_streams_go_on_after_a_restart(spark, tmp_path):
    echo = lambda *ids: spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "worker int, applied_id int")
    flows.ConfirmationWatermark(10, 75, f"{tmp_path}/w")(echo(5, 5, 5, 5), 0)
    again = flows.ConfirmationWatermark(10, 75, f"{tmp_path}/w")
    again(echo(2, 2, 2, 2), 1)
    again(echo(2, 2, 2, 2), 1)
    assert again.value == 5
    routing = spark.createDataFrame([(1, [1]), (9, [9])], "chunk_pk bigint, worker_ids array<bigint>")
    diffs = "assignment_id int, chunk_pk bigint, worker_ids array<bigint>"
    flows.DiffReplay(routing, 0, f"{tmp_path}/r")(spark.createDataFrame([(1, 1, [2]), (2, 2, [3])], diffs), 0)
    replay = flows.DiffReplay(routing, 0, f"{tmp_path}/r")
    assert replay.confirmed == 2
    for _ in range(2):
        replay(spark.createDataFrame([(2, 1, [7]), (3, 9, [])], diffs), 1)
        assert {r["chunk_pk"]: r["worker_ids"] for r in replay.routing.collect()} == {1: [2], 2: [3]}
    first = stale(spark, [(1, 1, 1), (1, 2, 3), (1, 3, 9)])
    log = lambda *rows: spark.createDataFrame(list(rows), "id int, created_at bigint, confirmed_up_to int")
    flows.DrainTimer(first, 20, lambda b: 60, f"{tmp_path}/d")(log((1, 30, 2)), 0)
    drain = flows.DrainTimer(first, 20, lambda b: 60, f"{tmp_path}/d")
    drain(log((2, 35, 4)), 1)
    assert [r["worker_pk"] for r in drain.stale.collect()] == [3] and drain.log.rows().count() == 2


def test_corrections_of_chunks_beyond_the_catalogue(spark, tmp_path):
    from lakekeel.plans.queries import QUERIES

    orders = [(k, 1, 10.0, "5-LOW") for k in (14994, 14996, 15006, 15055)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["old_pk"], r["refused"]) for r in QUERIES["mvcc_register_corrections"](spark, str(tmp_path)).collect())
    assert got == [(14994, None), (14996, "not live"), (15006, "unknown chunk"), (15055, "unknown chunk"), (15055, "unknown chunk")]
