"""Write and read schemas of datasets, bundles, table bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def read_documents(documents: DataFrame, key: str = "doc_key", document: str = "document") -> DataFrame:
    """Schema documents (JSON texts) as rows (key, error, canonical, hash): each is parsed once into a VARIANT, its tables are exploded, and all of them are judged in one
    plan. Right documents have one canonical text for all ways to write a schema, tables by name, fields sorted and distinct, and its SHA-256; wrong
    ones have the first reason by table name instead. Names are plain file stems, unique without regard to case; default fields must be fields. A null document is no JSON.

    A document is {"tables": {name: {"fields": [...], "default_fields": [...]}}}."""
    spark = documents.sparkSession
    own = documents.select(F.col(key).alias("k"), F.expr(f"try_parse_json(`{document}`)").alias("v")).withColumn("v", F.expr("try_variant_get(v, '$.tables', 'variant')"))
    tables = spark.sql("select d.k, t.key as name, try_variant_get(t.value, '$.fields', 'array<string>') as fields, try_variant_get(t.value, '$.default_fields', 'array<string>') as defaults from {d} d, lateral variant_explode(d.v) t where schema_of_variant(d.v) like 'OBJECT%'", d=own)
    tables = tables.withColumn("folded", F.count("*").over(Window.partitionBy("k", F.lower("name"))))  # a document's tables
    bad_name = (F.length("name") == 0) | F.col("name").isin(".", "..") | F.col("name").contains("/") | F.col("name").contains("\\") | F.col("name").contains("\0")
    strange = F.array_sort(F.array_except("defaults", "fields"))
    why = (
        F.when(bad_name, F.concat(F.lit("bad table name: "), "name"))
        .when(F.col("folded") > 1, F.concat(F.lit("table name repeats: "), F.lower("name")))
        .when(F.col("fields").isNull() | F.col("defaults").isNull(), F.concat("name", F.lit(": no lists of fields")))
        .when(F.size(strange) > 0, F.concat("name", F.lit(": default fields that are no fields: "), F.array_join(strange, ",")))
    )
    part = F.struct(F.array_sort(F.array_distinct("defaults")).alias("default_fields"), F.array_sort(F.array_distinct("fields")).alias("fields"))
    judged = tables.groupBy("k").agg(F.min(F.struct("name", why.alias("why"))).alias("any"), F.min(F.when(why.isNotNull(), F.struct("name", why.alias("why")))).alias("first"), F.array_sort(F.collect_list(F.struct("name", part.alias("table")))).alias("tables"))
    known = own.select("k", F.expr("coalesce(schema_of_variant(v) like 'OBJECT%', false)").alias("shaped")).join(judged, "k", "left")
    error = F.when(~F.col("shaped"), "no object of tables").otherwise(F.col("first.why"))
    listed = F.coalesce(F.to_json(F.map_from_entries(F.when(F.col("first").isNull(), F.col("tables")))), F.lit("{}"))
    canonical = F.when(F.col("error").isNull(), F.concat(F.lit('{"tables":'), listed, F.lit("}")))
    out = known.withColumn("error", error).withColumn("canonical", canonical)
    return out.select(F.col("k").alias(key), "error", "canonical", F.sha2("canonical", 256).alias("hash"))


def lower_chunks(new: DataFrame, schemas: DataFrame) -> DataFrame:
    """Ingest rows (schema_id, tables: names or null, ...) with `tables_present`, the bitmap over their schema's sorted table names (null for
    all), and `refused`, why a row cannot be stored, or null. schemas (schema_id, document) are those of the rows' dataset."""
    kind = "struct<tables: map<string, struct<fields: array<string>, default_fields: array<string>>>>"
    known = schemas.select("schema_id", F.from_json("document", kind)["tables"].alias("_tables"))
    own = new.join(known, "schema_id", "left")
    strange = F.size(F.array_except("tables", F.map_keys("_tables"))) > 0
    why = F.when(F.col("_tables").isNull(), "unknown schema").when(strange, "unknown table")
    why = F.coalesce(C.validate_chunk_range("first_block", "last_block", "size"), why)
    bitmap = F.when(F.col("refused").isNull(), C.resolve_tables("tables", "_tables"))
    return own.withColumn("refused", why).withColumn("tables_present", bitmap).select(*new.columns, "tables_present", "refused")


def active_schemas(schemas: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Schemas with `active`: used by a chunk that is pending, or admitted and not tombstoned. chunks (chunk_pk, schema_id)."""
    dead = meta.where(F.col("rejected") | C.tombstoned()).select("chunk_pk")
    used = chunks.join(dead, "chunk_pk", "left_anti").select("schema_id").distinct().withColumn("active", F.lit(True))
    return schemas.join(used, "schema_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def first_ids(schemas: DataFrame) -> DataFrame:
    return schemas.groupBy("dataset").agg(F.min("schema_id").alias("schema_id"))


def latest_ids(schemas: DataFrame) -> DataFrame:
    return schemas.groupBy("dataset").agg(F.max("schema_id").alias("schema_id"))


def register_write_schemas(known: DataFrame, new: DataFrame) -> DataFrame:
    """New (dataset, hash) pairs that are not there yet; the others keep their id."""
    return new.dropDuplicates(["dataset", "hash"]).join(known, ["dataset", "hash"], "left_anti")


def promote_read_schema(read: DataFrame, dataset: str, digest: str, now: int) -> DataFrame:
    """read (dataset, hash, current, superseded_at): exactly one current row per dataset afterwards."""
    mine = F.col("dataset") == dataset
    is_it = mine & (F.col("hash") == digest)
    moved = read.withColumn("superseded_at", F.when(is_it, F.lit(None)).when(mine & F.col("current"), F.lit(now)).otherwise(F.col("superseded_at")).cast("bigint"))
    moved = moved.withColumn("current", F.when(mine, F.col("hash") == digest).otherwise(F.col("current")))
    own = read.sparkSession.createDataFrame([(dataset, digest, True, None)], "dataset string, hash string, current boolean, superseded_at bigint")
    return moved.unionByName(own.join(read, ["dataset", "hash"], "left_anti"))


def read_schema_ids(names: DataFrame, read: DataFrame) -> DataFrame:
    """Every named dataset with the id of its current read schema, null if none was ever promoted."""
    return names.join(read.where("current").select("dataset", F.col("schema_id").alias("read_schema_id")), "dataset", "left")


def schemas_by_id(wanted: DataFrame, schemas: DataFrame) -> DataFrame:
    """The named schemas; an id that is not there is an error."""
    own = wanted.select("schema_id").distinct().join(schemas.withColumn("_there", F.lit(True)), "schema_id", "left")
    missing = F.raise_error(F.concat(F.lit("no schema with id "), F.col("schema_id").cast("string")))
    return own.select(F.when(F.col("_there").isNull(), missing.cast("int")).otherwise(F.col("schema_id")).alias("schema_id"), *[c for c in schemas.columns if c != "schema_id"])


def read_schemas_by_id(names: DataFrame, read: DataFrame) -> DataFrame:
    """The current read schemas of the named datasets; one without a read schema has no row."""
    return read.where("current").join(names.select("dataset").distinct(), "dataset", "left_semi").select("schema_id", "dataset", "hash")


def bundle_ids(published: DataFrame, schemas: DataFrame, read: DataFrame) -> DataFrame:
    """The bundle id of every assignment at once: published (assignment_id, schema_id), schemas (schema_id, dataset, hash), read as in read_schemas_by_id. An id is the
    SHA-256 of the write schemas and the current read schemas of their datasets, each in the order of ids; tags keep the two sections and their entries apart. An id
    that is not there is an error."""
    own = published.select("assignment_id", "schema_id").distinct()
    write = own.join(schemas_by_id(own, schemas.select("schema_id", "dataset", "hash")), "schema_id")
    current = read.where("current").select("schema_id", "dataset", "hash")
    theirs = write.select("assignment_id", "dataset").distinct().join(current, "dataset")
    lines = write.select("assignment_id", F.lit(0).alias("section"), "schema_id", "hash").unionByName(theirs.select("assignment_id", F.lit(1).alias("section"), "schema_id", "hash"))
    text = F.concat(F.col("schema_id").cast("string"), F.lit(":"), F.length("hash").cast("string"), F.lit(":"), "hash")
    sections = lines.withColumn("line", text).groupBy("assignment_id", "section").agg(F.expr("listagg(line, '') within group (order by schema_id)").alias("body"))
    both = sections.groupBy("assignment_id").agg(*[F.coalesce(F.max(F.when(F.col("section") == i, F.col("body"))), F.lit("")).alias(n) for i, n in enumerate(("w", "r"))])
    whole = F.concat(F.lit("schema-bundle\0write\0"), "w", F.lit("read\0"), "r")
    return both.select("assignment_id", F.sha2(whole, 256).alias("bundle_id"))


def generate_bundle(published: DataFrame, schemas: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Id (one row), write section and read section of the bundle for the published schema ids; an id that is not there is an error."""
    write = schemas_by_id(published, schemas.select("schema_id", "dataset", "hash"))
    ids = bundle_ids(published.select(F.lit(0).alias("assignment_id"), "schema_id"), schemas, read)
    return ids.select("bundle_id"), write, read_schemas_by_id(write, read)


def bundle_refs(published: DataFrame, schemas: DataFrame) -> DataFrame:
    """Published schema ids with their dataset; an id that resolves to nothing shows with a null dataset."""
    return published.join(schemas.select("schema_id", "dataset"), "schema_id", "left")


def routable_schemas(chunks: DataFrame, meta: DataFrame, ideal: DataFrame) -> DataFrame:
    """Schema ids that workers may need: of chunks that entered and are not tombstoned, and of the new ideal."""
    entered = chunks.join(meta.where(C.entered_worker() & ~C.tombstoned()).select("chunk_pk"), "chunk_pk", "left_semi")
    placed = chunks.join(ideal.select("chunk_pk"), "chunk_pk", "left_semi")
    return entered.select("schema_id").unionByName(placed.select("schema_id")).distinct()
