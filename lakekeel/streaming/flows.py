"""The stream-shaped parts: latest pings, the confirmation watermark, replay of the diff log, drains.

What a stream must remember lies in tables by batch id (Snapshots), so a restarted query goes on where it was, and a
batch that comes again writes the same snapshot again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators import fleet, lifecycle
from ..plans.state import new_folder, remove_folder, shared_folder


class Snapshots:
    """A state table: one snapshot for each batch that changed it, in `folder` (a new one in the shared folder by default)."""

    def __init__(self, spark: SparkSession, schema: StructType, folder: str | None = None):
        self.spark, self.schema = spark, schema
        self.folder = folder or f"{shared_folder(spark.range(0))}/stream-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        """All snapshots, with their batch."""
        try:
            return self.spark.read.schema(StructType([*self.schema.fields]).add("batch", LongType())).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("batch", LongType()))

    def before(self, batch_id: int | None, first: DataFrame) -> DataFrame:
        """The newest snapshot older than the batch (None: of all), or `first`."""
        known = self.rows() if batch_id is None else self.rows().where(F.col("batch") < batch_id)
        last = known.agg(F.max("batch")).first()[0]
        return first if last is None else self.at(last)

    def at(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={batch_id}")

    def keep(self, n: int) -> None:
        """Removes all snapshots but the newest n."""
        batches = sorted(r[0] for r in self.rows().select("batch").distinct().collect())  # one a snapshot that is there
        for old in batches[:-n]:
            remove_folder(self.spark, f"{self.folder}/batch={old}")

    def remove(self) -> None:
        """Removes the folder with all snapshots, once nobody reads them any more."""
        remove_folder(self.spark, self.folder)

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")


def latest_pings(pings: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Latest ping of each worker over a stream (update mode); pings later than the horizon are dropped."""
    return pings.withWatermark("ts", horizon).groupBy("worker_id").agg(F.max_by(F.struct("version", "stored_bytes", "current_epoch", "ts", "event_id"), F.struct("ts", "event_id")).alias("p")).select("worker_id", "p.*")


class ConfirmationWatermark:
    """Monotone quorum watermark for foreachBatch: echoes of a batch can only raise it. Ids above `latest` are ignored but
    their workers count in the quorum."""

    def __init__(self, latest: int, percent: int, folder: str | None = None):
        self.latest, self.percent, self.folder = latest, percent, folder
        self.state: Snapshots | None = None

    def _table(self, spark: SparkSession) -> tuple[Snapshots, DataFrame]:
        nothing = spark.createDataFrame([(0,)], "value bigint")
        if self.state is None:
            self.state = Snapshots(spark, nothing.schema, self.folder)
        return self.state, nothing

    @property
    def value(self) -> int:
        state, nothing = self._table(SparkSession.active())
        return state.before(None, nothing).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state, nothing = self._table(batch.sparkSession)
        known = batch.withColumn("applied_id", F.when(F.col("applied_id") <= self.latest, F.col("applied_id")))
        got = fleet.quorum_watermark(known, self.latest, self.percent).select(F.col("watermark").cast("bigint").alias("value"))
        state.write(state.before(batch_id, nothing).unionByName(got).agg(F.coalesce(F.max("value"), F.lit(0)).alias("value")), batch_id)


class EchoQuorum:
    """Monotone quorum watermark for foreachBatch over changes of echoes (timers.echo_changes). What it keeps is a count for each echoed id and the last
    value, one small snapshot a batch, of which only the last two stay."""

    def __init__(self, spark: SparkSession, latest: int, percent: int, folder: str | None = None):
        self.latest, self.percent = latest, percent
        self.start = spark.createDataFrame([], "kind string, id bigint, c bigint")
        self.table = Snapshots(spark, self.start.schema, folder)

    @property
    def value(self) -> int:
        row = self.table.before(None, self.start).where("kind = 'value'").first()
        return row["id"] if row else 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        known = self.table.before(batch_id, self.start)
        moves = F.explode(F.array(F.struct(F.col("now").alias("id"), F.lit(1).alias("c")), F.struct(F.col("before").alias("id"), F.lit(-1).alias("c"))))
        own = batch.select(moves.alias("m")).select("m.id", "m.c").where(F.col("id").isNotNull()).groupBy("id").agg(F.sum("c").alias("c"))
        folder = new_folder(batch.sparkSession, "moves")
        own.write.parquet(folder)  # the batch is read once; each read would run the stateful step again
        own = batch.sparkSession.read.schema(own.schema).parquet(folder).select(F.lit("count").alias("kind"), "id", "c")
        counts = known.where("kind = 'count'").unionByName(own).groupBy("kind", "id").agg(F.sum("c").alias("c")).where("c > 0")
        got = fleet.quorum_of_counts(counts.select(F.col("id").alias("applied_id"), "c"), self.latest, self.percent).select(F.col("watermark").cast("bigint").alias("id"))
        value = known.where("kind = 'value'").select("id").unionByName(got).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))
        self.table.write(counts.unionByName(value.select(F.lit("value").alias("kind"), "id", F.lit(1).cast("bigint").alias("c"))), batch_id)
        remove_folder(batch.sparkSession, folder)
        self.table.keep(2)


class DiffReplay:
    """Idempotent replay for foreachBatch: the routing after all diffs up to the largest id seen. A batch that comes again
    changes nothing."""

    def __init__(self, routing: DataFrame, confirmed: int = 0, folder: str | None = None):
        self.first = routing.select("chunk_pk", "worker_ids")
        spark = routing.sparkSession
        self.table = Snapshots(spark, self.first.schema, folder and f"{folder}/routing")
        self.start = spark.createDataFrame([(confirmed,)], "confirmed bigint")
        self.marks = Snapshots(spark, self.start.schema, folder and f"{folder}/confirmed")

    @property
    def routing(self) -> DataFrame:
        return self.table.before(None, self.first)

    @property
    def confirmed(self) -> int:
        return self.marks.before(None, self.start).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        confirmed = self.marks.before(batch_id, self.start).first()[0]
        target = batch.agg(F.max("assignment_id")).first()[0] or 0
        if target > confirmed:
            self.table.write(lifecycle.replay(self.table.before(batch_id, self.first), batch, confirmed, target), batch_id)
            self.marks.write(batch.sparkSession.createDataFrame([(target,)], self.start.schema), batch_id)


class DrainTimer:
    """Drains for foreachBatch over portal log rows: stale pairs expire as aged portal assignments confirm them. `now` gives
    the tick of a batch. The log grows by the rows of each batch; nothing of it is written twice."""

    def __init__(self, stale: DataFrame, ticks: int, now: Callable[[int], int], folder: str | None = None):
        self.first, self.ticks, self.now, self.folder = stale, ticks, now, folder
        self.table = Snapshots(stale.sparkSession, stale.schema, folder and f"{folder}/stale")
        self.log: Snapshots | None = None

    @property
    def stale(self) -> DataFrame:
        return self.table.before(None, self.first)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.log is None:
            self.log = Snapshots(batch.sparkSession, batch.schema, self.folder and f"{self.folder}/log")
        self.log.write(batch, batch_id)
        log = self.log.rows().where(F.col("batch") <= batch_id).drop("batch")
        self.table.write(lifecycle.expire_stale(self.table.before(batch_id, self.first), log, self.now(batch_id), self.ticks), batch_id)
