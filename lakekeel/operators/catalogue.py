"""The chunk catalogue: rows to chunks and back, discovery from object listings, summaries, paging, backfills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashes as H
from . import intervals


def dedup_catalogue(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the smallest in the given order (any version would do; this one is reproducible)."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (*order, *keys)])).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def chunk_from_row(rows: DataFrame) -> DataFrame:
    """Catalogue rows as chunks: files split and sorted, summary only if it has a hash or a time."""
    parsed = C.parse_chunk_id("id")
    has = F.col("last_block_hash").isNotNull() | (F.col("last_block_timestamp") != 0)
    files = F.array_sort(F.split("files", ","))
    return rows.select(
        "dataset", "id",
        F.when(F.col("size") > 2**32 - 1, F.raise_error(F.lit("size is too large"))).otherwise(F.col("size")).alias("size"),
        parsed["first_block"].alias("first_block"), parsed["last_block"].alias("last_block"), files.alias("files"),
        F.when(has, F.struct("last_block_hash", "last_block_timestamp")).alias("summary"),
    )


def chunk_to_row(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "dataset", "id", "size", F.array_join("files", ",").alias("files"), F.col("summary.last_block_hash").alias("last_block_hash"),
        F.coalesce("summary.last_block_timestamp", F.lit(0)).cast("bigint").alias("last_block_timestamp"),
    )


def discover_chunks(objects: DataFrame, required: str = "blocks.parquet") -> DataFrame:
    """Listed objects (prefix, file_name, size, dataset) as chunks. An incomplete chunk is skipped where it is the last
    of its dataset (still being written); elsewhere it is an error."""
    chunks = objects.groupBy("dataset", "prefix").agg(
        F.sum("size").alias("size"), F.count("*").alias("n_files"), F.bool_or(F.col("file_name") == required).alias("complete"), F.array_sort(F.collect_list("file_name")).alias("files")
    )
    last = chunks.groupBy("dataset").agg(F.max("prefix").alias("last_prefix"))
    joined = chunks.join(last, "dataset")
    state = F.when(F.col("complete"), "ok").when(F.col("prefix") == F.col("last_prefix"), "pending").otherwise("error")
    return joined.withColumn("state", state).drop("last_prefix", "complete")


def after(objects: DataFrame, last_id: str, key: str = "key") -> DataFrame:
    """Objects beyond all files of a chunk."""
    return objects.where(F.col(key) > C.resume_after(F.lit(last_id)))


def block_summary(blocks: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The block with the largest slot (else number) of each chunk, of several the first row of the file (the smallest `row`): its hash and
    time in milliseconds. Columns that a file lacks are passed over; a block without a hash is an error."""
    position = F.coalesce(*[F.col(c) for c in ("slot", "number") if c in blocks.columns])
    kind = dict(blocks.dtypes).get("timestamp")
    time = F.lit(0).cast("bigint") if kind is None else F.unix_millis("timestamp") if kind.startswith("timestamp") else F.col("timestamp").cast("bigint") * 1000
    block_hash = F.when(F.col("hash").isNull(), F.raise_error(F.lit("no hash of block found"))).otherwise(F.col("hash"))
    best = blocks.groupBy(*keys).agg(F.max_by(F.struct(F.col("number"), block_hash.alias("hash"), time.alias("ts")), F.struct(position.alias("p"), (-F.col(row)).alias("r"))).alias("b"))
    return best.select(*keys, F.col("b.number").alias("last_block"), F.col("b.hash").alias("last_block_hash"), F.col("b.ts").alias("last_block_timestamp"))


def row_counts(rows: DataFrame, chunk: str, table: str) -> DataFrame:
    """Map of table to number of rows for each chunk."""
    counts = rows.groupBy(chunk, table).agg(F.count("*").alias("n"))
    return counts.groupBy(chunk).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(table, "n")))).alias("row_counts"))


def footer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (chunk, table, n) of Parquet files under folder/chunk=.../table=..., from their footers alone: the count is pushed into the scan, which the
    second version of the source can do by partition columns. Files that cannot be read, and files without rows, have no row here."""
    own = spark.newSession()  # its settings are not the caller's
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true")):
        own.conf.set(name, value)
    files = own.read.schema("chunk string, table string").option("basePath", folder).option("ignoreCorruptFiles", "true").parquet(folder)
    return files.groupBy("chunk", "table").agg(F.count("*").alias("n"))


#: Bytes up to which a file without a counted row may be one without rows.
EMPTY_FILE_BYTES = 1 << 16


def file_row_counts(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Rows (chunk, row_counts): a map of table to rows for each chunk, null if one of its expected files (chunk, table) is missing or cannot be read. An empty file is
    told from a broken one by its first and last bytes, which are read of small files only."""
    small = spark.read.format("binaryFile").option("basePath", folder).load(folder).where(F.col("length") <= EMPTY_FILE_BYTES)
    magic = F.lit("PAR1").cast("binary")
    sound = small.where((F.substring("content", 1, 4) == magic) & (F.substring("content", -4, 4) == magic)).select("chunk", "table").distinct().withColumn("empty", F.lit(0).cast("bigint"))
    found = expected.join(footer_counts(spark, folder), ["chunk", "table"], "left").join(sound, ["chunk", "table"], "left")
    counted = found.withColumn("n", F.coalesce("n", "empty")).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("table", "n"))).alias("t"), F.bool_or(F.col("n").isNull()).alias("bad"))
    return counted.select("chunk", F.when(~F.col("bad"), F.map_from_entries("t")).alias("row_counts"))


def head(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Resume point of each dataset: the last block of its highest chunk that is not rejected; pending ones count."""
    own = chunks.join(meta.select("chunk_pk", "rejected"), "chunk_pk", "left").where(~F.coalesce("rejected", F.lit(False)))
    return own.groupBy("dataset").agg(F.max_by("last_block", "first_block").alias("last_block"), F.max_by("chunk_pk", "first_block").alias("chunk_pk"))


def watermarks(datasets: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Every dataset with its last chunk, or null."""
    return datasets.join(head(chunks, meta), "dataset", "left")


def continuity_gaps(chunks: DataFrame) -> DataFrame:
    """Where a chunk does not begin right after the one before it (overlaps show too)."""
    own = intervals.before(chunks, "last_block", "_last").withColumn("expected", F.col("_last") + 1)
    return own.where("first_block <> expected").select("dataset", "expected", "first_block", (F.col("first_block") - 1).alias("missing_to"))


def dataset_stats(chunks: DataFrame) -> DataFrame:
    span = F.col("last_block") - F.col("first_block") + 1
    return chunks.groupBy("dataset").agg(
        F.count("*").alias("chunk_count"), F.max("last_block").alias("head_block"), F.sum(span).alias("_span"), F.sum("size").alias("_size")
    ).select("dataset", "chunk_count", "head_block", F.expr("_span div chunk_count").alias("avg_span"), F.expr("_size div chunk_count").alias("avg_size"))


def duplicate_ids(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def keyset_page(rows: DataFrame, after_dataset: str, after_id, limit: int, id_col: str = "id") -> DataFrame:
    beyond = (F.col("dataset") > after_dataset) | ((F.col("dataset") == after_dataset) & (F.col(id_col) > after_id))
    return rows.where(beyond).orderBy("dataset", id_col).limit(limit)


def shard(rows: DataFrame, shards: int, index: int, *keys: str, counts: str | None = None) -> DataFrame:
    """The rows of one shard of `shards` by sipHash64 of the keys; with `counts`, a map column, only those whose map is empty."""
    mine = H.umod(H.siphash64_of(*keys), shards) == index
    return rows.where(mine if counts is None else (F.size(counts) == 0) & mine)


def copy_dataset(chunks: DataFrame, meta: DataFrame, source: str, target: str) -> DataFrame:
    """Clones of a dataset's live admitted chunks in another one."""
    live = meta.where(C.live_admitted()).select("chunk_pk")
    return chunks.where(F.col("dataset") == source).join(live, "chunk_pk", "left_semi").withColumn("dataset", F.lit(target))


def replace_dataset(chunks: DataFrame, dataset: str, first_new_pk: int) -> DataFrame:
    """A correction of the same range for every chunk of a dataset: old_pk, new_pk and the new chunk's columns."""
    own = chunks.where(F.col("dataset") == dataset).select("dataset", F.col("chunk_pk").alias("old_pk"), "first_block", "last_block", "size")
    number = F.lit(first_new_pk - 1) + F.col("number")
    return intervals.numbered(own, "old_pk").select("old_pk", number.cast("bigint").alias("new_pk"), "first_block", "last_block", "size")


def extend_datasets(stats: DataFrame, n: int, seed: int) -> DataFrame:
    """n new chunks after the datasets' heads: datasets drawn in proportion to their chunks, ranges of average span. Drawn by
    hash, so that every run gives the same. stats as of dataset_stats, a row a dataset."""
    total = stats.agg(F.sum("chunk_count").alias("total"))
    upto = F.sum("chunk_count").over(Window.orderBy("dataset"))  # one row per dataset
    table = F.broadcast(stats.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("chunk_count")))
    draws = stats.sparkSession.range(n).crossJoin(F.broadcast(total)).withColumn("draw", F.pmod(C.md5_60(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), F.col("total")))
    own = draws.join(table, (F.col("draw") >= F.col("from")) & (F.col("draw") < F.col("upto")))
    k = F.row_number().over(Window.partitionBy("dataset").orderBy("id"))
    first = F.col("head_block") + 1 + (k - 1) * F.col("avg_span")
    return own.select("dataset", first.alias("first_block"), (first + F.col("avg_span") - 1).alias("last_block"), F.col("avg_size").alias("size"))


def page_offset(rows: DataFrame, page: int, size: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset(page * size).limit(size)


def dataset_by_offset(rows: DataFrame, n: int, exclude: list[str]) -> DataFrame:
    return rows.select("dataset").distinct().where(~F.col("dataset").isin(exclude)).orderBy("dataset").offset(n).limit(1)


def last_block_inference(chunks: DataFrame, last: DataFrame) -> DataFrame:
    """Last blocks where only first blocks are known: one before the next chunk's first, else the dataset's last."""
    own = intervals.following(chunks, "_next").join(last, "dataset", "left")
    return own.withColumn("inferred_last", F.coalesce(F.col("_next") - 1, "dataset_last")).select(*chunks.columns, "inferred_last")


def clear_last_block_hash(chunks: DataFrame) -> DataFrame:
    """Keep the hash on the last chunk of each dataset only."""
    own = intervals.following(chunks, "_next")
    return own.withColumn("last_block_hash", F.when(F.col("_next").isNull(), F.col("last_block_hash"))).select(*chunks.columns)


def insert_with_datasets(rows: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known datasets, and the names that are unknown."""
    return rows.join(datasets, "dataset"), rows.join(datasets, "dataset", "left_anti").select("dataset").distinct()


def missing_datasets(configured: DataFrame, existing: DataFrame) -> DataFrame:
    return configured.join(existing, "dataset", "left_anti").select("dataset").distinct()


def known_plus_new(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known chunks, then the newly found ones; an id that is known stays as it is."""
    return known.unionByName(new.join(known, ["dataset", "id"], "left_anti"))


def apply_updates(rows: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with new values where there are any."""
    fresh = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(fresh, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, n)."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
