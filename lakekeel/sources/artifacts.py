"""What is published: assignments, bundles of status, metrics, and the tables' writers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def assignment_frame(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nested assignment: per worker its chunks, per chunk its place and files."""
    own = pairs.join(chunks, "chunk_pk")
    return own.groupBy("worker_pk").agg(F.array_sort(F.collect_list(F.struct("dataset", "first_block", "last_block", "chunk_pk", "size"))).alias("chunks"))


def replication_frame(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    from ..operators.movement import min_replication_by_weight

    return min_replication_by_weight(chunks, pairs)


def status_lines(config: str, workers: DataFrame, datasets: DataFrame, assigned_at: int) -> DataFrame:
    """The published status as lines of JSON (part, line), to be written as text: the head, then a line for each worker and dataset."""
    spark = workers.sparkSession
    head = spark.range(1).select(F.lit("head").alias("part"), F.to_json(F.struct(F.lit(config).alias("config"), F.lit(assigned_at).alias("assignment_timestamp_sec"))).alias("line"))
    rows = lambda df, name: df.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("line"))
    return head.unionByName(rows(workers, "worker")).unionByName(rows(datasets, "dataset"))


def open_metrics(metrics: DataFrame) -> DataFrame:
    """Lines of OpenMetrics text from rows (name, labels map, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(F.regexp_replace(e["value"], r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return metrics.select("name", F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def metrics_text(metrics: DataFrame) -> str:
    """The whole exposition: a type line for each family, samples, the end mark."""
    out, last = [], None
    for row in open_metrics(metrics).orderBy("name", "line").collect():
        if row["name"] != last:
            out.append(f"# TYPE {row['name']} gauge")
            last = row["name"]
        out.append(row["line"])
    return "\n".join([*out, "# EOF"]) + "\n"


def append_catalogue(rows: DataFrame, path: str) -> None:
    """New catalogue rows; copies are dropped when the catalogue is read."""
    rows.write.mode("append").partitionBy("dataset").parquet(path)


_POINTER = "CURRENT"


def replace_table(df: DataFrame, path: str) -> None:
    """A new snapshot in place of the old one: written to a folder of its own, then a pointer moves to it in one rename. A write that fails leaves the
    table as it was; the folder before the last one is removed, so that a reader may finish."""
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    home = hadoop.Path(path)
    fs = home.getFileSystem(conf)
    before = _pointed(spark, path)
    out = fs.create(hadoop.Path(home, f".{folder}"), True)
    out.writeBytes("\n".join([folder, *before[:1]]))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = getattr(hadoop.Options.Rename, "OVERWRITE")
    qualified = lambda name: fs.makeQualified(hadoop.Path(home, name))
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(qualified(f".{folder}"), qualified(_POINTER), overwrite)
    for old in before[1:]:
        fs.delete(hadoop.Path(home, old), True)


def _pointed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the current snapshot and the one before; empty without a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path, _POINTER)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/{_POINTER}", wholetext=True).collect()][0].split("\n")


def current_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_pointed(spark, path)[0]}")


def persist_assignment_schemas(schema_ids: DataFrame, path: str) -> None:
    """The schema ids of the published assignment replace those of the one before."""
    replace_table(schema_ids.select("schema_id").distinct(), path)


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows with aggregates that are counted as they pass by, whatever is done with them; read them from the observation afterwards."""
    watch = Observation()
    return df.observe(watch, *[c.alias(n) for n, c in counts.items()]), watch


def observed_gauges(spark: SparkSession, watch: Observation) -> DataFrame:
    """Gauge rows (name, labels, value) of what an observation has counted."""
    rows = [(name, {}, int(value or 0)) for name, value in watch.get.items()]
    return spark.createDataFrame(rows, "name string, labels map<string,string>, value bigint")


def _family(rows: DataFrame, name: str, value: Column, **labels: Column) -> DataFrame:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(name).alias("name"), made.alias("labels"), value.cast("double").alias("value"))


def segment_label(dataset: Column, seg_from: Column, only: Column) -> Column:
    """The dataset alone if its one segment begins at 0, else with the segment's beginning."""
    return F.when(only & (seg_from == 0), dataset).otherwise(F.concat(dataset, F.lit("["), seg_from.cast("string"), F.lit("..]")))


def fleet_gauges(stats: DataFrame, factors: DataFrame, multiplier: DataFrame, loads: DataFrame, statuses: DataFrame, stale_below: int, assigned_at: DataFrame) -> DataFrame:
    """Rows (name, labels, value) of the families by segment and by worker. stats (dataset, seg_from, num_chunks, total_size), factors (dataset, seg_from, factor),
    multiplier (multiplier) and assigned_at (at) of one row, loads (worker, chunks, bytes), statuses (worker, status). A least load below the bound is a failure."""
    one = stats.groupBy("dataset").agg((F.count("*") == 1).alias("only"))
    by_segment = lambda df: df.join(one, "dataset", "left").withColumn("label", segment_label(F.col("dataset"), F.col("seg_from"), F.coalesce("only", F.lit(False))))
    place, share = by_segment(stats), by_segment(factors)
    segment = {"dataset_segment": F.col("label"), "dataset": F.col("dataset")}
    least = loads.agg(F.min("bytes").alias("least")).where(F.col("least") < stale_below)
    out = [
        _family(place, "dataset_segment_chunks", F.col("num_chunks"), **segment), _family(place, "dataset_segment_size", F.col("total_size"), **segment), _family(share, "replication_factor", F.col("factor"), **segment),
        _family(multiplier, "weight_multiplier", F.col("multiplier")), _family(loads, "worker_assigned_chunks", F.col("chunks"), worker=F.col("worker")), _family(loads, "worker_assigned_size", F.col("bytes"), worker=F.col("worker")),
        _family(statuses, "worker_in_status", F.lit(1), worker=F.col("worker"), status=F.col("status")), _family(least, "failure", F.lit(1), target=F.lit("min_assignment")), _family(assigned_at, "assignment_timestamp", F.col("at")),
    ]
    return reduce(DataFrame.unionByName, out)


def gauges(chunks: DataFrame, pairs: DataFrame, statuses: DataFrame, rejected: DataFrame, held_back: DataFrame) -> DataFrame:
    """Rows (name, labels, value) of the gauge families that follow from the tables. statuses (status, workers); rejected and held_back
    (dataset, n)."""

    def family(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
        return rows.select(F.lit(name).alias("name"), F.create_map(F.lit(label), F.col(label).cast("string")).alias("labels"), F.col(value).cast("bigint").alias("value"))

    stored = chunks.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    placed = pairs.join(chunks.select("chunk_pk", "dataset", "size"), "chunk_pk").groupBy("dataset").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    out = family(stored, "dataset_chunks", "dataset", "n").unionByName(family(stored, "dataset_size", "dataset", "bytes"))
    out = out.unionByName(family(placed, "assigned_chunks", "dataset", "n")).unionByName(family(placed, "assigned_size", "dataset", "bytes"))
    out = out.unionByName(family(statuses, "worker_status", "status", "workers"))
    return out.unionByName(family(rejected, "registration_rejected", "dataset", "n")).unionByName(family(held_back, "promotion_held_back", "dataset", "n"))
