"""Statuses, versions, quorums, the worker set."""

import datetime as dt

from pyspark.sql import functions as F

from lakekeel.functions import columns as C
from lakekeel.operators import fleet


def status(spark, **row):
    base = {"version": "2.13.0", "stored_bytes": 1000, "ts": 2000, "epoch": 100}
    df = spark.createDataFrame([{**base, **row}], "version string, stored_bytes bigint, ts bigint, epoch int")
    col = C.worker_status("version", "stored_bytes", "ts", "epoch", inactive_before=F.lit(1000), stale_below=600, min_version="2.10.1", max_epoch=F.lit(101), max_epoch_lag=2)
    return df.select(col).first()[0]


def test_status_ladder(spark):
    assert status(spark) == "online"
    assert status(spark, epoch=98) == "stale_rpc"
    assert status(spark, epoch=99) == "online"
    assert status(spark, epoch=None) == "stale_rpc"
    assert status(spark, stored_bytes=599, epoch=1) == "stale"
    assert status(spark, stored_bytes=600) == "online"
    assert status(spark, version="2.10.0", stored_bytes=1) == "unsupported_version"
    assert status(spark, version="2.10.1-rc1") == "unsupported_version"
    assert status(spark, version="nonsense") == "unsupported_version"
    assert status(spark, version=None) == "unsupported_version"
    assert status(spark, ts=999, version=None) == "offline"


def test_version_order(spark):
    ordered = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0", "1.0.1-rc1", "1.0.1", "1.2.0", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string")
    assert [r["i"] for r in df.orderBy(C.version_key("v")).collect()] == list(range(len(ordered)))
    assert spark.range(1).select(C.version_key(F.lit("1.2"))).first()[0] is None


def quorum(spark, echoes, latest, percent):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(echoes)], "worker int, applied_id int")
    return fleet.quorum_watermark(df, latest, percent).first()[0]


def test_quorum(spark):
    assert quorum(spark, [5, 4, 3, 2], 10, 75) == 3
    assert quorum(spark, [5, 4, 3, 2], 10, 100) == 2
    assert quorum(spark, [5, 4, 3, None], 10, 75) == 3  # silent workers count
    assert quorum(spark, [5, 4, None, None], 10, 75) is None
    assert quorum(spark, [5, 99, 3, 2], 10, 50) == 3  # beyond the latest: ignored, still counted
    assert quorum(spark, [7, 7, 7], 10, 1) == 7
    assert quorum(spark, [], 10, 0) == 10


def test_latest_ping_window_and_ties(spark):
    t = dt.datetime(2024, 1, 10, 12)
    rows = [(1, t, 1), (1, t, 2), (1, t - dt.timedelta(hours=1), 9), (2, t - dt.timedelta(hours=25), 3), (3, t - dt.timedelta(hours=24), 4)]
    df = spark.createDataFrame(rows, "worker_id int, ts timestamp_ntz, event_id int")
    assert {r["worker_id"]: r["event_id"] for r in fleet.latest_pings(df).collect()} == {1: 2, 3: 4}


def test_worker_set(spark):
    known = spark.createDataFrame([(1, "a", "1.0.0", None), (2, "b", "1.0.0", 5), (3, "c", "1.0.0", None), (4, "d", None, 7)], "worker_pk bigint, peer_id string, version string, inactive_since bigint")
    active = spark.createDataFrame([("a", "1.0.0"), ("b", "1.0.0"), ("e", None)], "peer_id string, version string")
    got = {r["peer_id"]: (r["inactive_since"], r["change"]) for r in fleet.worker_set(known, active, 60).collect()}
    assert got == {"a": (None, "same"), "b": (None, "returned"), "c": (60, "departed"), "d": (7, "absent"), "e": (None, "inserted")}


def test_gc_is_strict(spark):
    workers = spark.createDataFrame([(1, 49), (2, 50), (3, None)], "worker_pk bigint, inactive_since bigint")
    stale = spark.createDataFrame([(9, 1, 1), (9, 2, 1)], "chunk_pk bigint, worker_pk bigint, superseded_at int")
    left, pairs = fleet.gc_workers(workers, stale, 60, 10)
    assert {r["worker_pk"] for r in left.collect()} == {2, 3}
    assert [r["worker_pk"] for r in pairs.collect()] == [2]


def test_ids_and_bitmaps(spark):
    row = spark.range(1).select(
        C.format_chunk_id(F.lit(1), F.lit(20), F.lit(30), F.lit(255)).alias("id"),
        C.parse_chunk_id(F.lit("0000000001/0000000020-0000000030-000000ff"))["last_block"].alias("last"),
        C.parse_chunk_id(F.lit("nonsense")).alias("bad"),
        C.resolve_tables(F.array(F.lit("b")), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1))).alias("some"),
        C.resolve_tables(F.array(F.lit("b"), F.lit("a")), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1))).alias("all"),
        C.resolve_tables(F.array().cast("array<string>"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1))).alias("none"),
        C.chunk_files(F.lit("01"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1))).alias("files"),
        C.chunk_files(F.lit(None).cast("string"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(1))).alias("every"),
    ).first()
    assert row["id"] == "0000000001/0000000020-0000000030-000000ff" and row["last"] == 30 and row["bad"] is None
    assert (row["some"], row["all"], row["none"]) == ("01", None, "00")
    assert row["files"] == ["b.parquet"] and row["every"] == ["a.parquet", "b.parquet"]
