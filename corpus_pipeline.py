"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All stages but the last return the columns of documents.

Defined cases, in every stage: rows with a null doc_id are judged by their text like others, but the line dedup and the Jaccard
join leave them as they are; null, empty and wordless texts are rejected by the classifier and kept by the stages after it; texts of any
length are taken whole; repeated rows get the same verdict, and of their lines only those of the first stay; an empty table gives an
empty one; further columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeel.llm import bpe, decontaminate, jaccard, linededup, quality
from lakekeel.llm.common import fresh, materialise


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (low quality or toxic) go; without labels only the fixed words mark toxic ones."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _with_size(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents none of whose lines stays. Documents without lines stay. Ties in place go to the smaller id."""
    before, after = fresh(docs.columns, "lines_before", "lines_after")
    out = linededup.dedup_lines(docs, counts=(before, after))
    return _with_size(out.where((F.col(before) == 0) | (F.col(after) > 0)).drop(before, after))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates stays, in all its rows."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark spans are cut from the others. Items without text or id are passed over."""
    return _with_size(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to. docs is the table that the stage before has written."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, stable=True)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encode),
]

#: The classifier and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
