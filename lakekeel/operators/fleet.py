"""Workers: latest pings, statuses, versions, watermarks, the worker set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def recent_pings(pings: DataFrame, horizon: str = "1 day", ts: str = "ts") -> DataFrame:
    """Pings of the last day of data, not of the clock: one scalar, broadcast."""
    newest = pings.agg(F.max(ts).alias("newest_ts"))
    return pings.join(F.broadcast(newest), F.col(ts) >= F.col("newest_ts") - F.expr(f"interval {horizon}")).drop("newest_ts")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation, so that a hot key does not gather."""
    rest = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns])
    best = df.select(*keys, rest.alias("_row")).groupBy(*keys).agg(F.max("_row").alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_pings(pings: DataFrame) -> DataFrame:
    return latest_per_key(recent_pings(pings), ["worker_id"], F.col("ts"), F.col("event_id"))


def worker_statuses(pings: DataFrame, *, min_version: str, stale_below: int, max_epoch_lag: int | None, inactive_timeout: str, now: Column | None = None) -> DataFrame:
    """Each worker's status from its latest ping; the epoch baseline is the largest epoch among these."""
    latest = latest_pings(pings)
    base = latest.agg(F.max("current_epoch").alias("max_epoch"), F.max("ts").alias("now_ts"))
    before = (F.col("now_ts") if now is None else now) - F.expr(f"interval {inactive_timeout}")
    status = C.worker_status(
        "version", "stored_bytes", "ts", "current_epoch",
        inactive_before=before, stale_below=stale_below, min_version=min_version, max_epoch=F.col("max_epoch"), max_epoch_lag=max_epoch_lag,
    )
    return latest.crossJoin(F.broadcast(base)).withColumn("status", status).drop("max_epoch", "now_ts")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("workers"))


def version_distribution(workers: DataFrame) -> DataFrame:
    """Workers by version in version order, without one as 'none' first."""
    counts = workers.groupBy(F.coalesce("version", F.lit("none")).alias("version")).agg(F.count("*").alias("workers"))
    return counts.orderBy(C.version_key("version").asc_nulls_first(), "version")


def quorum_watermark(echoes: DataFrame, latest: int, percent: int) -> DataFrame:
    """The k-th largest echoed id in (0, latest], k = max(1, ceil(n * percent / 100)); n counts silent workers too.
    percent 0 gives `latest`; fewer than k echoes give null. Counts per id are aggregated before they are ranked."""
    if percent == 0:
        return echoes.agg(F.lit(latest).cast("int").alias("watermark"))
    return quorum_of_counts(echoes.groupBy("applied_id").agg(F.count("*").alias("c")), latest, percent)


def quorum_of_counts(counts: DataFrame, latest: int, percent: int) -> DataFrame:
    """The same from counts (applied_id, c) of all echoes, silent ones too: a row for each id."""
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    running = counts.where(F.col("applied_id").between(1, latest)).withColumn("reached", F.sum("c").over(Window.orderBy(F.desc("applied_id"))))  # as many rows as assignments are echoed
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100)).cast("bigint")
    return n.join(running, F.col("reached") >= k, "left").agg(F.max("applied_id").cast("int").alias("watermark"))


def lagged_watermark(published: DataFrame, lag: int) -> DataFrame:
    """The id `lag` publications before each one, clamped to the first."""
    w = Window.orderBy("id")
    return published.select("id", F.coalesce(F.lag("id", lag).over(w), F.first("id").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("watermark"))


def worker_set(known: DataFrame, active: DataFrame, now: int) -> DataFrame:
    """Merge the active workers into the known ones: new ones are added, seen ones refreshed and active again, departed
    ones stamped once. known (worker_pk, peer_id, version, inactive_since); active (peer_id, version)."""
    seen = active.select(F.col("peer_id").alias("p"), F.col("version").alias("v"))
    both = known.join(seen, known["peer_id"] == seen["p"], "full_outer")
    return both.select(
        "worker_pk",
        F.coalesce("peer_id", "p").alias("peer_id"),
        F.when(F.col("p").isNotNull(), F.col("v")).otherwise(F.col("version")).alias("version"),
        F.when(F.col("p").isNull(), F.coalesce("inactive_since", F.lit(now).cast("bigint"))).alias("inactive_since"),
        F.when(F.col("peer_id").isNull(), "inserted")
        .when(F.col("p").isNull(), F.when(F.col("inactive_since").isNull(), "departed").otherwise("absent"))
        .when(F.col("inactive_since").isNotNull(), "returned")
        .when(~F.col("v").eqNullSafe(F.col("version")), "refreshed")
        .otherwise("same").alias("change"),
    )


def gc_workers(workers: DataFrame, stale: DataFrame, now: int, ticks: int) -> tuple[DataFrame, DataFrame]:
    """Forget workers inactive since before now - ticks, with their stale pairs."""
    gone = workers.where(F.col("inactive_since") < now - ticks).select("worker_pk")
    return workers.join(gone, "worker_pk", "left_anti"), stale.join(F.broadcast(gone), "worker_pk", "left_anti")


def portal_statuses(statuses: DataFrame, recommended: str) -> DataFrame:
    return statuses.withColumn("portal_status", C.portal_worker_status("status", "version", recommended))
