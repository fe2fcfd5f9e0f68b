"""Hash rings: every ring orders the workers by another hash; a replica goes to the next workers after its own hash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashes as H

#: Rings; every replica's hash chooses one.
RINGS = 6000


def _u16(n: Column | str) -> Column:
    """Two bytes, the lower one first."""
    n = C.col(n).cast("int")
    return F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0")))


def build_rings(workers: DataFrame, rings: int = RINGS, peer: str = "peer_id") -> DataFrame:
    """Rows (ring, pos, hash, worker_pk): workers by hash in each ring; hash is the seahash of `peer:ring` less 2^63, so that its order is the unsigned
    one. Workers times rings, both bounded by the fleet."""
    entries = workers.select("worker_pk", peer, F.explode(F.sequence(F.lit(0), F.lit(rings - 1))).alias("ring"))
    key = F.concat(F.col(peer).cast("binary"), F.lit(":").cast("binary"), _u16("ring"))
    hashed = entries.select("ring", "worker_pk", H.ordered(H.seahash(key)).alias("hash"))
    return hashed.withColumn("pos", F.row_number().over(Window.partitionBy("ring").orderBy("hash", "worker_pk")) - 1)


def cached_rings(workers: DataFrame, folder: str, rings: int = RINGS, peer: str = "peer_id") -> DataFrame:
    """The rings as a table in `folder`, named by a fingerprint of the workers; built only when their list has changed."""
    listed = workers.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", F.col("worker_pk").cast("string"), peer)))), 256)).first()[0]  # fleet-sized
    path = f"{folder}/rings-{rings}-{listed[:32]}"
    spark = workers.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build_rings(workers, rings, peer).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replica_hashes(chunks: DataFrame, replicas, id_col: str = "chunk_id") -> DataFrame:
    """Rows (chunk_pk, tag, hash) for tags 0 to replicas - 1: the seahash of `dataset/id:tag` less 2^63."""
    tagged = chunks.select("chunk_pk", "dataset", F.col(id_col).cast("string").alias("id"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("tag"))
    key = F.concat(F.concat("dataset", F.lit("/"), "id", F.lit(":")).cast("binary"), _u16("tag"))
    return tagged.select("chunk_pk", "tag", H.ordered(H.seahash(key)).alias("hash"))


def with_ring(hashes: DataFrame, rings: int = RINGS) -> DataFrame:
    """With the ring that the unsigned hash chooses."""
    return hashes.withColumn("ring", H.umod(H.unordered(F.col("hash")), rings).cast("int"))


def ring_home(hashes: DataFrame, rings: DataFrame) -> DataFrame:
    """The first worker at or after each replica's hash on its ring, wrapping around: one sort of both together per
    ring, no cross join. hashes (chunk_pk, tag, hash, ring)."""
    entry = rings.select("ring", "hash", F.lit(1).alias("kind"), "worker_pk", F.lit(None).cast("bigint").alias("chunk_pk"), F.lit(None).cast("int").alias("tag"))
    keys = hashes.select("ring", "hash", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("worker_pk"), "chunk_pk", "tag")
    # from the largest hash down, the last worker seen is the next one above; at equal hashes the worker counts, the
    # smallest worker first
    down = Window.partitionBy("ring").orderBy(F.desc("hash"), F.desc("kind"), F.desc("worker_pk"))
    seen = F.last("worker_pk", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    first = rings.where("pos = 0").select("ring", F.col("worker_pk").alias("first_worker"))
    walked = entry.unionByName(keys).withColumn("home", seen).where("kind = 0").join(F.broadcast(first), "ring")
    return walked.select("chunk_pk", "tag", "ring", "hash", F.coalesce("home", "first_worker").alias("worker_pk"))


def next_workers(rings: DataFrame, workers: DataFrame, minimums: DataFrame, k: int) -> DataFrame:
    """Rows (ring, class, hash, pos, next): on each ring the workers that may serve a minimum version, each with the k workers from it on, wrapping
    around; `class` is the minimum version, '' for none. minimums (class): a few rows of configuration."""
    listed = minimums.agg(F.array_sort(F.collect_set("class")).alias("classes"))  # one row
    known = workers.select("worker_pk", "version").crossJoin(F.broadcast(listed)).withColumn("class", F.explode("classes"))
    able = known.where(C.version_eligible("version", F.nullif("class", F.lit("")))).select("worker_pk", "class")
    own = rings.select("ring", "hash", "worker_pk").join(able, "worker_pk")
    by_hash = Window.partitionBy("ring", "class").orderBy("hash", "worker_pk")
    own = own.withColumns({"pos": F.row_number().over(by_hash) - 1, "n": F.count("*").over(Window.partitionBy("ring", "class"))})
    around = own.where(F.col("pos") < k - 1).withColumn("pos", F.col("pos") + F.col("n"))  # the beginning once more, after the end
    ahead = Window.partitionBy("ring", "class").orderBy("pos").rowsBetween(0, k - 1)
    both = own.unionByName(around).withColumn("next", F.collect_list("worker_pk").over(ahead)).where("pos < n")
    return both.select("ring", "class", "hash", "pos", F.expr(f"slice(next, 1, least(n, {k}))").alias("next"))


def successors(keys: DataFrame, rings: DataFrame, workers: DataFrame, k: int) -> DataFrame:
    """keys (chunk_pk, hash, ring, minimum: least version or null, copies up to k) with `worker_ids`: the first `copies` distinct workers at or after the hash that
    may serve the chunk, in the order of the ring; fewer if there are no more. One sort of keys and entries per ring and class; every key
    takes the array of the last entry seen, cut to its copies."""
    own = keys.withColumn("class", F.coalesce("minimum", F.lit("")))
    table = next_workers(rings, workers, own.select("class").distinct(), k)
    entry = table.select("ring", "class", "hash", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("chunk_pk"), F.lit(None).cast("int").alias("copies"), "pos", "next")
    asked = own.select("ring", "class", "hash", F.lit(0).alias("kind"), "chunk_pk", F.col("copies").cast("int").alias("copies"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<bigint>").alias("next"))
    down = Window.partitionBy("ring", "class").orderBy(F.desc("hash"), F.desc("kind"), F.desc("pos"))
    seen = F.last("next", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    first = table.where("pos = 0").select("ring", "class", F.col("next").alias("first"))
    walked = entry.unionByName(asked).withColumn("found", seen).where("kind = 0").join(first, ["ring", "class"], "left")
    nobody = F.array().cast("array<bigint>")
    return walked.select("chunk_pk", "ring", F.slice(F.coalesce("found", "first", nobody), F.lit(1), F.col("copies")).alias("worker_ids"))
