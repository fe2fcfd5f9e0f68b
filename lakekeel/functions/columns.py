"""Column expressions: ids, paths, versions, statuses, hashes, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_60(x: Column | str) -> Column:
    """First 60 bits of MD5 as a bigint: the placement hash, the same on every engine."""
    return F.conv(F.substring(F.md5(col(x)), 1, 15), 16, 10).cast("bigint")


# ---- ids and paths


def format_chunk_id(top: Column | str, first: Column | str, last: Column | str, tag: Column | str) -> Column:
    return F.concat(F.lpad(col(top).cast("string"), 10, "0"), F.lit("/"), F.lpad(col(first).cast("string"), 10, "0"), F.lit("-"), F.lpad(col(last).cast("string"), 10, "0"), F.lit("-"), F.lpad(F.lower(F.hex(col(tag))), 8, "0"))


_CHUNK_ID = r"^(\d+)/(\d+)-(\d+)-([0-9A-Za-z]+)$"


def parse_chunk_id(chunk_id: Column | str) -> Column:
    """Struct (top, first_block, last_block, tag); null for an id of another form."""
    c = col(chunk_id)
    part = lambda i: F.regexp_extract(c, _CHUNK_ID, i)
    return F.when(c.rlike(_CHUNK_ID), F.struct(part(1).cast("bigint").alias("top"), part(2).cast("bigint").alias("first_block"), part(3).cast("bigint").alias("last_block"), part(4).alias("tag")))


def bucket_of(dataset: Column | str) -> Column:
    return F.regexp_replace(col(dataset), "^s3://", "")


def strip_scheme(location: Column | str) -> Column:
    return F.regexp_replace(col(location), "^.*?://", "")


def split_object_key(key: Column | str) -> Column:
    """Struct (prefix, file_name) at the last slash; null without one."""
    c = col(key)
    return F.when(c.contains("/"), F.struct(F.regexp_extract(c, "^(.*)/([^/]*)$", 1).alias("prefix"), F.regexp_extract(c, "^(.*)/([^/]*)$", 2).alias("file_name")))


def resume_after(chunk_id: Column | str) -> Column:
    """First key after all files of a chunk: the separator '/' sorts right before '0'."""
    return F.concat(col(chunk_id), F.lit("0"))


def download_url(bucket: Column | str, endpoint: str, path_style: bool) -> Column:
    host = endpoint.split("://")[-1]
    return F.concat(F.lit(f"http://{host}/"), col(bucket)) if path_style else F.concat(F.lit("https://"), col(bucket), F.lit(f".{host}"))


# ---- versions

_VERSION = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(version: Column | str) -> Column:
    """A comparable struct for a semantic version, or null if it is not one.

    A pre-release comes before its release. Its identifiers compare dot by dot: numbers by value and before words;
    a longer list follows its own beginning.
    """
    v = col(version)
    part = lambda i: F.regexp_extract(v, _VERSION, i)
    pre = part(4)
    order = F.transform(
        F.split(pre, r"\."),
        lambda x: F.when(x.rlike(r"^\d+$"), F.struct(F.lit(1).alias("kind"), x.cast("bigint").alias("number"), F.lit("").alias("word"))).otherwise(
            F.struct(F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("number"), x.alias("word"))
        ),
    )
    nothing = F.array().cast("array<struct<kind:int,number:bigint,word:string>>")
    return F.when(
        v.rlike(_VERSION),
        F.struct(
            part(1).cast("bigint").alias("major"), part(2).cast("bigint").alias("minor"), part(3).cast("bigint").alias("patch"),
            (pre == "").cast("int").alias("release"), F.when(pre == "", nothing).otherwise(order).alias("pre"),
        ),
    )


def version_eligible(worker: Column | str, minimum: Column | str) -> Column:
    """A worker may serve if the chunk has no minimum, or its version is known and not below it."""
    return col(minimum).isNull() | F.coalesce(version_key(worker) >= version_key(minimum), F.lit(False))


# ---- statuses


def worker_status(version, stored_bytes, ts, epoch, *, inactive_before: Column, stale_below: int, min_version: str, max_epoch: Column, max_epoch_lag: int | None) -> Column:
    """offline, unsupported_version, stale, stale_rpc or online: the first that holds, in this order."""
    lagging = F.lit(False)
    if max_epoch_lag is not None:
        lagging = max_epoch.isNotNull() & (col(epoch).isNull() | (col(epoch) < F.greatest(F.lit(0), max_epoch - max_epoch_lag)))
    return (
        F.when(col(ts) < inactive_before, "offline")
        .when(F.coalesce(version_key(version) < version_key(F.lit(min_version)), F.lit(True)), "unsupported_version")
        .when(col(stored_bytes) < stale_below, "stale")
        .when(lagging, "stale_rpc")
        .otherwise("online")
    )


def reliable(status: Column | str) -> Column:
    return col(status) == "online"


def portal_worker_status(status: Column | str, version: Column | str, recommended: str) -> Column:
    key = version_key(version)
    return (
        F.when(col(status) == "unsupported_version", "unsupported_version")
        .when(col(status) != "online", "unreliable")
        .when(F.coalesce(key < version_key(F.lit(recommended)), F.lit(False)), "deprecated_version")
        .otherwise("ok")
    )


# ---- lifecycle predicates over the columns of a chunk's metadata


def entered_worker() -> Column:
    return F.col("applied_worker").isNotNull()


def entered_portal() -> Column:
    return F.col("applied_portal").isNotNull()


def confirmed_by(watermark: Column | int) -> Column:
    return F.coalesce(F.col("applied_worker") <= watermark, F.lit(False))


def portal_visible() -> Column:
    return F.col("applied_portal").isNotNull() & F.col("dropped_portal").isNull()


def tombstoned() -> Column:
    return F.col("dropped_worker").isNotNull()


def in_removal() -> Column:
    return F.col("marked").isNotNull()


def active() -> Column:
    return ~tombstoned() & ~F.col("rejected")


def live_admitted() -> Column:
    return ~F.col("rejected") & F.col("marked").isNull() & F.col("dropped_portal").isNull() & F.col("dropped_worker").isNull()


def worker_servable() -> Column:
    return entered_worker() & active()


# ---- rows and values


def needs_backfill() -> Column:
    return F.col("last_block_hash").isNull() | (F.col("last_block_timestamp") == 0)


def parse_applied_id(echo: Column | str) -> Column:
    """The numeric echo of an assignment, else null."""
    c = col(echo).cast("string")
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int"))


def adapt_timestamp(ts: Column | str) -> Column:
    """Milliseconds for values in seconds or milliseconds; 0 stays; null if neither lies in 2009 to 2025."""
    c = col(ts)
    ok = lambda ms: F.year(F.timestamp_millis(ms)).between(2009, 2025)
    return F.when(c == 0, c).when(ok(c), c).when(ok(c * 1000), c * 1000)


def validate_chunk_range(first: Column | str, last: Column | str, size: Column | str) -> Column:
    """The reason why a range cannot be stored, or null."""
    f, l, s = col(first), col(last), col(size)
    return F.when(l < f, "last block precedes first").when(l - f > 2**31 - 1, "span is too large").when((s < 0) | (s > 2**31 - 1), "size is too large")


# ---- table bitmaps


def resolve_tables(names: Column | str, tables: Column | str) -> Column:
    """Bitmap text over the sorted table names of a schema: null names or all of them give null, none gives all 0."""
    n, t = col(names), F.array_sort(F.map_keys(col(tables)))
    bits = F.array_join(F.transform(t, lambda x: F.when(F.array_contains(n, x), "1").otherwise("0")), "")
    unknown = F.array_except(n, t)
    known = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown table: "), F.element_at(unknown, 1)))).otherwise(bits)
    return F.when(n.isNull(), F.lit(None)).when(F.size(F.array_except(t, n)) == 0, F.when(F.size(unknown) > 0, known)).otherwise(known)


def chunk_files(bitmap: Column | str, tables: Column | str) -> Column:
    """File names of the tables present; a null bitmap means all."""
    b, t = col(bitmap), F.array_sort(F.map_keys(col(tables)))
    present = F.filter(t, lambda x, i: b.isNull() | (F.substring(b, i + 1, F.lit(1)) == "1"))
    files = F.transform(present, lambda x: F.concat(x, F.lit(".parquet")))
    return F.when(b.isNotNull() & (F.length(b) != F.size(t)), F.raise_error(F.lit("bitmap does not fit the schema"))).otherwise(files)
