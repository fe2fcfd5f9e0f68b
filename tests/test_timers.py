"""Timers of streams against a plain walk, with a restart between two parts of the rows."""

import random
from datetime import datetime, timedelta

import pytest

from lakekeel.streaming import flows, timers

START = datetime(2024, 1, 1)
AFTER = 60_000


def walk(rows):
    """Expiries of rows (key, ms, starts, tie); timers fire at the end if the latest row has passed them."""
    out, last = [], max(r[1] for r in rows)
    for key in {r[0] for r in rows}:
        mine = sorted((ms, tie, starts) for k, ms, starts, tie in rows if k == key)
        for (ms, _, starts), nxt in zip(mine, [*mine[1:], None]):
            if starts and (nxt[0] > ms + AFTER if nxt else ms + AFTER <= last):
                out.append((key, ms, ms + AFTER))
    return sorted(out)


@pytest.mark.parametrize("cuts", [(), (0.5,), (0.3, 0.8)])
def test_timers_fire_once_over_restarts(spark, tmp_path, cuts):
    timers.use_rocksdb(spark)
    rng = random.Random(len(cuts))
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    rows = sorted(((f"k{rng.randrange(7)}", base + rng.randrange(900_000), rng.random() < 0.8, i) for i in range(150)), key=lambda r: r[1])
    schema = "pair string, ts timestamp, begins boolean, event_id bigint"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    bounds = [0, *[int(c * len(rows)) for c in cuts], len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        part = [(k, START + timedelta(milliseconds=ms - base), s, i) for k, ms, s, i in rows[a:b]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = timers.run_to_end(spark, timers.drained(source, AFTER), f"{tmp_path}/run")
    assert sorted((r["pair"], r["started"], r["expired"]) for r in got.collect()) == walk(rows)
    again = timers.run_to_end(spark, timers.drained(source, AFTER), f"{tmp_path}/run")  # nothing new
    assert again.count() == got.count()


def test_offline_workers(spark, tmp_path):
    timers.use_rocksdb(spark)
    rows = [(1, START, 1), (1, START + timedelta(minutes=10), 2), (2, START + timedelta(minutes=1), 3), (3, START + timedelta(hours=2), 4)]
    spark.createDataFrame(rows, "worker_id bigint, ts timestamp, event_id bigint").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("worker_id bigint, ts timestamp, event_id bigint").parquet(f"{tmp_path}/in")
    got = timers.run_to_end(spark, timers.offline_workers(source, 3_600_000), f"{tmp_path}/run").collect()
    minute = lambda r: (r["started"] - int((START - datetime(1970, 1, 1)).total_seconds() * 1000)) // 60_000
    assert sorted((r["worker_id"], minute(r)) for r in got) == [(1, 10), (2, 1)]


def test_quorum_of_online_workers_over_a_restart(spark, tmp_path):
    """Four workers echo 3, 3, 3, 1; then three fall silent and the fourth goes on to 2: the watermark stays at 3, and only the fourth is left."""
    timers.use_rocksdb(spark)
    schema = "worker_id bigint, ts timestamp, applied_id int, event_id bigint"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        quorum = flows.EchoQuorum(spark, 10, 75, f"{tmp_path}/quorum")
        changes = timers.echo_changes(source, 3_600_000)
        changes.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).foreachBatch(quorum).start().awaitTermination()
        counts = {r["id"]: r["c"] for r in quorum.table.before(None, quorum.start).where("kind = 'count'").collect()}
        assert quorum.table.rows().select("batch").distinct().count() <= 2
        return quorum.value, counts

    minute = lambda m: START + timedelta(minutes=m)
    assert step([(w, minute(w), 3 if w < 4 else 1, w) for w in (1, 2, 3, 4)] + [(4, minute(1), 9, 0)]) == (3, {3: 3, 1: 1})
    assert step([(4, minute(200), 2, 9), (4, minute(90), None, 8)]) == (3, {2: 1})
    assert step([(5, minute(201), None, 10), (4, minute(202), 5, 11)]) == (3, {5: 1, -1: 1})
    assert step([(5, minute(203), 6, 12)]) == (5, {5: 1, 6: 1})


def test_buckets_hold_many_keys(spark, tmp_path, monkeypatch):
    """Keys that share a bucket, null and text keys, late rows and a timer that ends with the last row, against a plain walk; a call serves all keys of a bucket."""
    monkeypatch.setattr(timers, "BUCKETS", 2)
    timers.use_rocksdb(spark)
    rng = random.Random(12)
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    rows = sorted(((rng.choice([None, "", "a", "=", *(f"k{i}" for i in range(20))]), base + rng.randrange(900) * 1000, rng.random() < 0.8, i) for i in range(300)), key=lambda r: (r[1], r[3]))
    rows += [("edge", rows[-1][1], True, 500), ("last", rows[-1][1] + AFTER, True, 501)]
    schema = "pair string, ts timestamp, begins boolean, event_id bigint"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame([(k, START + timedelta(milliseconds=ms - base), s, i) for k, ms, s, i in part], schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = timers.run_to_end(spark, timers.drained(source, AFTER), f"{tmp_path}/run")
    assert got.schema == source.select("pair").schema.add("started", "long").add("expired", "long")
    order = lambda x: (x[0] or "", x[0] is None, x[1])
    want = [(k, ms, e) for k in {r[0] for r in rows} for _, ms, e in walk([("x", *r[1:]) for r in rows if r[0] == k] + [("y", rows[-1][1], False, 0)])]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_quorum_reads_a_batch_once(spark, tmp_path):
    """A second read of a stream's batch would run its stateful step again."""
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    batch = spark.createDataFrame([(i, None if i % 3 else 2, 5) for i in range(30)], "worker_id bigint, before bigint, now bigint").mapInPandas(count, "worker_id bigint, before bigint, now bigint")
    quorum = flows.EchoQuorum(spark, 10, 75, f"{tmp_path}/quorum")
    quorum(batch, 0)
    assert quorum.value == 5 and read.value == 30
    assert {r["id"]: r["c"] for r in quorum.table.before(None, quorum.start).where("kind = 'count'").collect()} == {5: 30}


def test_snapshots_can_be_removed(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "value bigint")
    table = flows.Snapshots(spark, rows.schema, f"{tmp_path}/s")
    table.write(rows, 3)
    assert table.rows().count() == 1
    table.remove()
    assert table.rows().count() == 0 and not (tmp_path / "s").exists()
