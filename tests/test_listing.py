"""Paged listings as a data source: batch and stream against a plain walk, with chunks that are still being written."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from lakekeel.sources import listing
from lakekeel.streaming import timers


def put(folder, bucket, number, objects):
    """One more inventory file of a bucket, sorted by key."""
    (folder / f"bucket={bucket}").mkdir(parents=True, exist_ok=True)
    rows = sorted(objects)
    pq.write_table(pa.table({"key": [k for k, _ in rows], "size": pa.array([s for _, s in rows], pa.int64())}), folder / f"bucket={bucket}/{number}.parquet")


def chunk(bucket, first, last, files=("blocks", "logs", "traces")):
    return [(f"{bucket}/0000000000/{first:010d}-{last:010d}-abcd/{name}.parquet", first + i) for i, name in enumerate(files)]


def walk(objects, bucket):
    """(first block, size, files, state) of a bucket's chunks."""
    own: dict = {}
    for key, size in sorted(objects):
        own.setdefault(key.rpartition("/")[0], []).append((key.rpartition("/")[2], size))
    out, expected = [], None
    for prefix, files in own.items():
        first, last = (int(x) for x in prefix.rpartition("/")[2].split("-")[:2])
        whole = "blocks.parquet" in [f for f, _ in files]
        if not whole and prefix == max(own):
            continue
        out.append((first, sum(s for _, s in files), len(files), "incomplete" if not whole else "gap" if expected not in (None, first) else "ok"))
        expected = last + 1 if whole else expected
    return out


def test_pages_of_every_size_give_the_same_chunks(spark, tmp_path):
    rng = random.Random(5)
    objects = {}
    for bucket in ("a", "b", "empty-end"):
        at, rows = 0, []
        for _ in range(40):
            last = at + rng.randint(0, 9)
            files = rng.sample(["blocks", "logs", "traces", "x", "y"], rng.randint(1, 5))
            rows += chunk(bucket, at, last, files if rng.random() < 0.3 else ["blocks", *[f for f in files if f != "blocks"]])
            at = last + 1 + (rng.random() < 0.1)
        if bucket == "empty-end":
            rows += chunk(bucket, at, at + 3, ["logs"])
        objects[bucket] = rows
        half = len(rows) // 2
        put(tmp_path, bucket, 0, rows[::2])  # files of an inventory need not follow one another
        put(tmp_path, bucket, 1, rows[1::2])
        assert half
    for page in (1, 2, 3, 7, 1000):
        got = listing.read_chunks(spark, listing.manifest(str(tmp_path)), page).collect()
        for bucket, rows in objects.items():
            mine = sorted((r["first_block"], r["size"], r["n_files"], r["state"]) for r in got if r["dataset"] == f"s3://{bucket}")
            assert mine == walk(rows, bucket), (page, bucket)


def test_a_stream_goes_on_after_its_offset(spark, tmp_path):
    inventory, run = tmp_path / "in", str(tmp_path / "run")
    inventory.mkdir()
    lister = listing.manifest(str(inventory))
    put(inventory, "a", 0, chunk("a", 0, 9) + chunk("a", 10, 19) + chunk("a", 20, 29, ["logs"]))
    rows = lambda: sorted((r["dataset"], r["first_block"], r["state"]) for r in timers.run_to_end(spark, listing.read_chunks(spark, lister, 2, stream=True), run).collect())
    assert rows() == [("s3://a", 0, "ok"), ("s3://a", 10, "ok")]
    assert rows() == [("s3://a", 0, "ok"), ("s3://a", 10, "ok")]
    put(inventory, "a", 1, chunk("a", 20, 29, ["blocks"]) + chunk("a", 40, 49))
    put(inventory, "b", 0, chunk("b", 7, 8))
    assert rows() == [("s3://a", 0, "ok"), ("s3://a", 10, "ok"), ("s3://a", 20, "ok"), ("s3://a", 40, "gap"), ("s3://b", 7, "ok")]


def test_ranges_of_a_bucket_and_row_groups(spark, tmp_path):
    """Ranges of few objects in row groups of two, cut inside chunks; incomplete chunks before a cut, the last whole chunk far from the end."""
    rng, rows, at = random.Random(7), [], 0
    for i in range(60):
        last = at + rng.randint(0, 9)
        rows += chunk("a", at, last, ["logs", "traces"] if 20 <= i < 30 or i >= 55 else ["a", "blocks", "logs", "traces"])
        at = last + 1 + (rng.random() < 0.2)
    (tmp_path / "bucket=a").mkdir()
    table = sorted(rows)
    for n, part in enumerate((table[:100], table[100:])):
        pq.write_table(pa.table({"key": [k for k, _ in part], "size": pa.array([s for _, s in part], pa.int64())}), tmp_path / f"bucket=a/{n}.parquet", row_group_size=2)
    lister = listing.manifest(str(tmp_path))
    for n in (1, 3, 50, 1000):
        got = listing.read_chunks(spark, lister, 5, rows=n)
        assert n > 100 or got.rdd.getNumPartitions() > 4
        assert sorted((r["first_block"], r["size"], r["n_files"], r["state"]) for r in got.collect()) == walk(rows, "a"), n
    stream = timers.run_to_end(spark, listing.read_chunks(spark, lister, 5, stream=True, rows=30), str(tmp_path / "run"))
    whole = max(f for f, _, _, state in walk(rows, "a") if state != "incomplete")
    assert sorted((r["first_block"], r["size"], r["n_files"], r["state"]) for r in stream.collect()) == [w for w in walk(rows, "a") if w[0] <= whole]


def test_a_page_reads_the_row_groups_it_needs(tmp_path, monkeypatch):
    keys = [f"a/{i:010d}-{i:010d}/blocks.parquet" for i in range(2000)]
    (tmp_path / "bucket=a").mkdir()
    pq.write_table(pa.table({"key": keys, "size": pa.array(range(2000), pa.int64())}), tmp_path / "bucket=a/0.parquet", row_group_size=100)
    read, own = [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, **k: read.append(i) or own(self, i, **k))
    lister = listing.manifest(str(tmp_path))
    assert lister.page("a", keys[1509], 10) == ([(k, 1510 + i) for i, k in enumerate(keys[1510:1520])], True)
    assert lister.page("a", keys[1519], 10)[0][0] == (keys[1520], 1520)
    assert lister.last("a", "blocks.parquet") == keys[-1]
    assert read == [15, 19]
