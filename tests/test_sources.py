"""Tables that are published, schemas, listings, rings."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lakekeel.operators import catalogue, schema_registry
from lakekeel.sources import artifacts


def test_metrics_text(spark):
    df = spark.createDataFrame([("b", {}, 2.0), ("a", {"y": 'q"', "x": "1"}, 1.0)], "name string, labels map<string,string>, value double")
    assert artifacts.metrics_text(df) == '# TYPE a gauge\na{x="1",y="q\\""} 1.0\n# TYPE b gauge\nb 2.0\n# EOF\n'


def test_catalogue_sink_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "i", 5), ("d", "i", 4), ("e", "j", 1)], "dataset string, id string, size bigint")
    artifacts.append_catalogue(rows, str(tmp_path / "c"))
    artifacts.append_catalogue(rows, str(tmp_path / "c"))
    got = catalogue.dedup_catalogue(spark.read.parquet(str(tmp_path / "c")).select("dataset", "id", "size"), ["dataset", "id"], "size")
    assert {tuple(r) for r in got.collect()} == {("d", "i", 4), ("e", "j", 1)}


def test_schema_documents(spark):
    text = lambda tables: json.dumps({"tables": tables})
    t = {"fields": ["a", "b"], "default_fields": ["a"]}
    rows = {
        1: text({"t": {"fields": ["b", "a", "a"], "default_fields": ["a"]}, "s": t}), 2: text({"s": t, "t": t}), 3: text({"t/x": t}), 4: text({"T": t, "t": t}), 5: text({"t": {"fields": [], "default_fields": ["z"]}}),
        6: "{", 7: None, 8: "[]", 9: text({}), 10: text({"": t}), 11: text({"..": t}), 12: text({"t": {"fields": 3}}), 13: '{"tables": 5}', 14: text({"a\\b": t}),
    }
    df = spark.createDataFrame(list(rows.items()), "doc_key int, document string").repartition(3)
    got = {r["doc_key"]: r for r in schema_registry.read_documents(df).collect()}
    assert got.keys() == rows.keys()
    assert {k for k, r in got.items() if r["error"] is None} == {1, 2, 9}
    want = json.dumps({"tables": {n: {"default_fields": ["a"], "fields": ["a", "b"]} for n in ("s", "t")}}, separators=(",", ":"), sort_keys=True)
    assert got[1]["canonical"] == got[2]["canonical"] == want and got[1]["hash"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[9]["canonical"] == '{"tables":{}}' and got[3]["error"] == "bad table name: t/x" and got[4]["error"] == "table name repeats: t" and got[5]["error"].endswith("no fields: z")
    assert all(got[k]["error"] == "no object of tables" and got[k]["hash"] is None for k in (6, 7, 8, 13))


def bundle_id(write, read):
    """Of {id: hash} sections."""
    digest = hashlib.sha256(b"schema-bundle\0")
    for tag, part in ((b"write\0", write), (b"read\0", read)):
        digest.update(tag)
        for key in sorted(part):
            digest.update(f"{key}:{len(part[key])}:{part[key]}".encode())
    return digest.hexdigest()


def test_read_pointer(spark):
    read = spark.createDataFrame([("d", "h1", True, None), ("e", "h9", True, None)], "dataset string, hash string, current boolean, superseded_at bigint")
    got = schema_registry.promote_read_schema(read, "d", "h2", 5)
    assert {(r["hash"], r["current"], r["superseded_at"]) for r in got.where("dataset = 'd'").collect()} == {("h1", False, 5), ("h2", True, None)}
    back = schema_registry.promote_read_schema(got, "d", "h1", 6)
    assert back.where("dataset = 'd' and current").collect()[0]["hash"] == "h1" and back.count() == 3


def test_discovery(spark):
    rows = [("d/1", "blocks.parquet", 5), ("d/1", "logs.parquet", 1), ("d/2", "logs.parquet", 1), ("d/3", "blocks.parquet", 1), ("d/4", "logs.parquet", 1)]
    objects = spark.createDataFrame([("d", *r) for r in rows], "dataset string, prefix string, file_name string, size bigint")
    assert {r["prefix"]: r["state"] for r in catalogue.discover_chunks(objects).collect()} == {"d/1": "ok", "d/2": "error", "d/3": "ok", "d/4": "pending"}


def test_row_counts_come_from_footers(spark, tmp_path):
    folder = f"{tmp_path}/files"
    rows = spark.range(1000).selectExpr("concat('c-', id % 5) as chunk", "if(id % 3 = 0, 'a', 'b') as table", "id as v")
    rows.repartition("chunk", "table").write.partitionBy("chunk", "table").parquet(folder)
    plan = catalogue.footer_counts(spark, folder)._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [chunk, table]" in plan
    (tmp_path / "files/chunk=c-6/table=a").mkdir(parents=True)
    (tmp_path / "files/chunk=c-6/table=a/x.parquet").write_text("PAR1 no footer")
    rows.where("false").select("v").write.parquet(f"{folder}/chunk=c-7/table=a")
    expected = rows.select("chunk", "table").distinct().unionByName(spark.createDataFrame([("c-6", "a"), ("c-7", "a"), ("c-8", "a"), ("c-0", "lost")], "chunk string, table string"))
    got = {r["chunk"]: r["row_counts"] for r in catalogue.file_row_counts(spark, folder, expected).collect()}
    assert got == {f"c-{i}": {"a": len([x for x in range(1000) if x % 5 == i and x % 3 == 0]), "b": len([x for x in range(1000) if x % 5 == i and x % 3])} for i in range(1, 5)} | {"c-0": None, "c-6": None, "c-7": {"a": 0}, "c-8": None}


def test_rings_are_kept_until_the_workers_change(spark, tmp_path):
    from lakekeel.operators import rings

    workers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "worker_pk bigint, peer_id string")
    want = sorted(map(tuple, rings.build_rings(workers, 5).select("ring", "pos", "hash", "worker_pk").collect()))
    for _ in range(2):
        got = rings.cached_rings(workers, str(tmp_path), 5)
        assert sorted(map(tuple, got.select("ring", "pos", "hash", "worker_pk").collect())) == want
    assert len(list(tmp_path.glob("rings-5-*"))) == 1
    assert rings.cached_rings(workers.where("worker_pk < 3"), str(tmp_path), 5).count() == 10
    assert len(list(tmp_path.glob("rings-5-*"))) == 2


def test_ring_successors_equal_a_nested_search(spark):
    from lakekeel.operators import rings

    rng = random.Random(3)
    versions = {w: rng.choice(["1.0.0", "2.0.0", "2.1.0-rc1", None]) for w in range(9)}
    workers = spark.createDataFrame([(w, f"p{w}", v) for w, v in versions.items()], "worker_pk bigint, peer_id string, version string")
    table = rings.build_rings(workers, 4)
    keys = [(i, rng.randrange(-(2**63), 2**63), rng.randrange(4), rng.choice([None, "2.0.0", "2.1.0-rc1", "9.0.0"]), rng.randint(1, 3)) for i in range(300)]
    keys += [(300 + r["worker_pk"], r["hash"], 0, None, 3) for r in table.where("ring = 0").collect()]  # right at an entry
    asked = spark.createDataFrame(keys, "chunk_pk bigint, hash bigint, ring int, minimum string, copies int").repartition(3)
    got = {r["chunk_pk"]: r["worker_ids"] for r in rings.successors(asked, table, workers, 3).collect()}
    entries = [(r["ring"], r["hash"], r["worker_pk"]) for r in table.collect()]
    able = {None: set(range(9)), "2.0.0": {w for w, v in versions.items() if v and v >= "2.0.0"}, "2.1.0-rc1": {w for w, v in versions.items() if v == "2.1.0-rc1"}, "9.0.0": set()}
    for pk, h, ring, minimum, copies in keys:
        walk = sorted((x < h, x, w) for r, x, w in entries if r == ring and w in able[minimum])
        assert got[pk] == [w for *_, w in walk[:copies]], pk


def test_bundle_of_published_schemas(spark, tmp_path):
    schemas = spark.createDataFrame([(1, "d", "h1"), (2, "d", "h2"), (3, "e", "h3")], "schema_id int, dataset string, hash string")
    read = spark.createDataFrame([(7, "d", "r7", True), (6, "d", "r6", False), (8, "f", "r8", True)], "schema_id int, dataset string, hash string, current boolean")
    published = spark.createDataFrame([(1,), (3,), (1,)], "schema_id int")
    name, write, own = schema_registry.generate_bundle(published, schemas, read)
    assert {r["schema_id"] for r in write.collect()} == {1, 3} and {r["schema_id"] for r in own.collect()} == {7}
    assert name.first()[0] == bundle_id({1: "h1", 3: "h3"}, {7: "r7"}) != bundle_id({1: "h1", 3: "h3"}, {})
    many = spark.createDataFrame([(1, 10), (1, 9), (2, 10), (2, 10)], "assignment_id int, schema_id int")
    wide = spark.createDataFrame([(9, "d", "nine"), (10, "g", "ten")], "schema_id int, dataset string, hash string")
    got = {r["assignment_id"]: r["bundle_id"] for r in schema_registry.bundle_ids(many, wide, read).collect()}
    assert got == {1: bundle_id({9: "nine", 10: "ten"}, {7: "r7"}), 2: bundle_id({10: "ten"}, {})}
    with pytest.raises(Exception, match="no schema with id"):
        schema_registry.generate_bundle(spark.createDataFrame([(99,)], "schema_id int"), schemas, read)[0].collect()


def test_a_table_is_replaced_by_moving_a_pointer(spark, tmp_path):
    path = f"{tmp_path}/schemas"
    for k in range(4):
        artifacts.persist_assignment_schemas(spark.createDataFrame([(k,), (k,)], "schema_id int"), path)
        assert [r[0] for r in artifacts.current_table(spark, path).collect()] == [k]
    assert len(list(tmp_path.glob("schemas/v-*"))) == 2  # the current one and the one before
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).cast("int").alias("schema_id"))
    with pytest.raises(Exception, match="no"):
        artifacts.replace_table(broken, path)
    assert [r[0] for r in artifacts.current_table(spark, path).collect()] == [3]


def test_observed_counts_take_no_second_pass(spark, tmp_path):
    spark.range(50).selectExpr("id % 7 as k", "id as size").write.parquet(f"{tmp_path}/in")
    seen, watch = artifacts.observed(spark.read.parquet(f"{tmp_path}/in"), keys=F.count("*"), bytes=F.sum("size"))
    out = seen.groupBy("k").agg(F.sum("size").alias("size"))
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1 and "CollectMetrics" in plan
    out.write.parquet(f"{tmp_path}/out")
    assert {r["name"]: r["value"] for r in artifacts.observed_gauges(spark, watch).collect()} == {"keys": 50, "bytes": 1225}


def test_block_summary_takes_the_first_row_and_needs_a_hash(spark):
    rows = spark.createDataFrame([("c", 5, "zz", 1), ("c", 5, "aa", 0), ("c", 4, "bb", 2)], "chunk string, number bigint, hash string, r bigint")
    assert catalogue.block_summary(rows, ["chunk"], "r").first()["last_block_hash"] == "aa"
    with pytest.raises(Exception, match="no hash of block"):
        catalogue.block_summary(spark.createDataFrame([("c", 5, None, 0)], rows.schema), ["chunk"], "r").collect()


def test_assignments_and_status(spark):
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "chunk_pk bigint, worker_pk bigint")
    chunks = spark.createDataFrame([(1, "d", 10, 19, 5), (2, "d", 0, 9, 6)], "chunk_pk bigint, dataset string, first_block bigint, last_block bigint, size bigint")
    assert [c["chunk_pk"] for c in artifacts.assignment_frame(pairs, chunks).first()["chunks"]] == [2, 1]
    lines = artifacts.status_lines('{"n":1}', spark.createDataFrame([("w", "online")], "peer string, status string"), spark.createDataFrame([("d", 2)], "dataset string, chunks bigint"), 9)
    status = {r["part"]: json.loads(r["line"]) for r in lines.collect()}
    assert status["head"]["assignment_timestamp_sec"] == 9 and status["worker"] == {"peer": "w", "status": "online"} and status["dataset"] == {"dataset": "d", "chunks": 2}
