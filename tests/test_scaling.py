"""Steps that must grow no faster than their input: results against brute force, and what their plans may not hold."""

import random

from lakekeel.operators import intervals, invariants, lifecycle


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rooms_are_counted_by_rank(spark):
    rng = random.Random(3)
    sizes, rooms = [rng.randint(-5, 20_000) for _ in range(200)] + [7, 7], [rng.randint(-9_000, 30_000) for _ in range(300)] + [7, 4096, 4096]
    frames = spark.createDataFrame([(s,) for s in sizes], "size bigint"), spark.createDataFrame([(i, r) for i, r in enumerate(rooms)], "worker_pk bigint, room bigint")
    got = {r["size"]: r["fit"] for r in invariants._fits(*frames).collect() if r["size"] in sizes}
    assert got == {s: sum(r >= s for r in rooms) for s in sizes}
    workers = spark.range(50).selectExpr("id as worker_pk", "cast(null as bigint) as inactive_since")
    chunks = spark.range(40).selectExpr("id as chunk_pk", "id * 10 as size")
    pairs = spark.range(20).selectExpr("id as chunk_pk", "id % 7 as worker_pk")
    own = invariants.feasible_but_short(chunks, pairs, workers, spark.sql("select cast(300 as bigint) as capacity"), 2)
    assert "collect_list" not in plan(own)  # no array of all workers beside each chunk
    used = [sum(c * 10 for c in range(20) if c % 7 == w) for w in range(50)]
    want = {c: sum(300 - used[w] >= c * 10 and not (c < 20 and c % 7 == w) for w in range(50)) for c in range(40)}
    assert {r["chunk_pk"]: r["roomy"] for r in own.collect()} == {c: n for c, n in want.items() if n + (c < 20) >= 2}


def test_probe_and_cover_take_one_pass(spark):
    rng = random.Random(4)
    ranges = lambda n, off: [("d%d" % rng.randint(0, 1), off + i, a := rng.randint(0, 1 << 22), a + rng.choice((0, 3, 5000, 1 << 21))) for i in range(n)]
    schema = "dataset string, id bigint, first_block bigint, last_block bigint"
    a, b = ranges(150, 0), ranges(12, 1000)
    probe = intervals.overlap_probe(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert "Generate" not in plan(probe)  # no row for each level of lengths
    assert {r["id"] for r in probe.collect()} == {x[1] for x in a if any(x[0] == y[0] and y[2] <= x[3] and x[2] <= y[3] for y in b)}
    cover = intervals.running_cover(spark.createDataFrame(a, schema), "id")
    assert plan(cover).count("Window [") == 2  # one over rows, one over bins
    order = sorted(a, key=lambda x: (x[2], x[1]))
    for r in cover.collect():
        before = [x for x in order if x[0] == r["dataset"] and (x[2], x[1]) < (r["first_block"], r["id"])]
        top = max((x[3] for x in before), default=None)
        assert (r["covered_to"], r["covered_by"]) == (top, next((x[1] for x in before if x[3] == top), None))


def test_admission_joins_all_chunks_once(spark, tmp_path):
    chunks = spark.sql("select id as chunk_pk, 'd' as dataset, id * 10 as first_block, id * 10 + case when id = 5 then 15 else 9 end as last_block from range(9)")
    chunks.write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    meta = chunks.where("chunk_pk < 4 or chunk_pk = 7").selectExpr("chunk_pk", "false as rejected", "1 as applied_worker", "1 as applied_portal", "cast(null as bigint) as marked", "cast(null as int) as dropped_portal", "cast(null as bigint) as dropped_worker")
    corrections = spark.sql("select 3 as old_pk, 8 as new_pk, cast(null as int) as applied_portal")
    own = lifecycle.register_new_chunks(chunks, meta, corrections)
    assert f"{tmp_path}/chunks" not in {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for f in own.inputFiles()}
    assert sorted(map(tuple, own.collect())) == [(4, False), (5, False), (6, True), (8, True)]


def test_ranges_visit_only_levels_near_them(spark):
    """Long ranges far away cost short ones no rows; rows do not grow with the number of lengths that there are."""
    short = [("d", i, i * 100, i * 100 + 9) for i in range(400)]
    far = [("d", 1000 + k, (40 + k) << 27, ((40 + k) << 27) + (1 << k)) for k in range(8, 27)]
    schema = "dataset string, id bigint, first_block bigint, last_block bigint"
    own = spark.createDataFrame(short + far, schema)
    levels = intervals._levels(own)
    assert intervals._in_bins(own, levels, 0, True).where("r.id < 1000").count() <= 2 * len(short)
    rng = random.Random(9)
    mixed = [("d%d" % (i % 2), i, a := rng.choice((0, 1 << 26, 1 << 33)) + rng.randint(-500, 1 << rng.choice((6, 12, 28))), a + rng.choice((0, 1, 8, 300, 70_000, 1 << 27, (1 << 27) + 1, 1 << 31))) for i in range(160)]
    left, right = mixed[::2] + mixed[:9], mixed[1::2] + mixed[:40]
    got = intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).select("left_id", "right_id").collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
