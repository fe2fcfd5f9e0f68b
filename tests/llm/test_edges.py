"""Every operator and every stage of the pipeline: nulls, empty and very long texts, ties, repeated rows, empty tables, names that clash."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lakekeel.llm import bpe, chat, decontaminate, divergence, htmltext, jaccard, licences, linededup, media, quality, resample, urlfilter, wordpiece

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
LONG = "A long text of words that goes on, line after line.\n" * 24_000  # 1.2 MB
PLAIN = "The same words stand here twice, and here once more."
ROWS = [(None, PLAIN), (None, None), (1, None), (2, ""), (3, LONG), (4, PLAIN), (4, PLAIN), (5, PLAIN), (5, "Other words under an id that is there already."), (6, " \n\t ")]
#: Names that operators use inside or give to their results.
CLASHES = "labels score spans block kind c h n key id line mask n_words n_tokens n_lines keep fragment payload ids parts first hit_key text_ n_kept lines_before lines_after kept_doc rank place rest"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(4)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES.split()])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PLAIN), (1, PLAIN), (None, "x y"), (2, None), (3, "..."), (4, LONG[:2000])], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 1), (None, 0, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "line dedup": lambda docs, bench, labels: linededup.dedup_lines(docs),
    "decontamination": lambda docs, bench, labels: decontaminate.contamination(docs, bench),
    "licence scan": lambda docs, bench, labels: licences.scan_licences(docs),
    "quality classifier": lambda docs, bench, labels: quality.classify(docs, labels),
    "encoding": lambda docs, bench, labels: bpe.encode_decode(docs, VOCABULARY, P.PATTERN),
    "media": lambda docs, bench, labels: media.media_columns(docs, with_media=False),
    "Jaccard join": lambda docs, bench, labels: jaccard.classes(docs),
    "token counts": lambda docs, bench, labels: wordpiece.token_counts(docs, VOCABULARY),
    "html": lambda docs, bench, labels: htmltext.page_texts(docs.withColumn("url", F.lit(None).cast("string")).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")),
    "url filter": lambda docs, bench, labels: urlfilter.url_verdicts(docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_and_out(name, docs, bench, labels):
    run = OPERATORS[name]
    got = run(docs, bench, labels).toPandas()
    assert len(got) == len(ROWS)
    key = got.columns[0]
    assert sorted(got[key].dropna().astype(int)) == sorted(i for i, _ in ROWS if i is not None) and got[key].isna().sum() == 2
    if name != "line dedup":  # of repeated rows the lines of one stay
        same = got[got[key] == 4].astype(str).drop_duplicates()
        assert len(same) == 1
    assert run(docs.limit(0), bench, labels).count() == 0
    assert run(docs.where("doc_id = 2"), bench.limit(0), labels.limit(0)).count() == 1


def test_operators_on_groups_and_draws(docs, bench):
    """Those that return no row a document: all documents count, clashing columns stay out of the way."""
    drawn = resample.resample(docs, bench, percent=100, least_words=0)
    assert drawn.columns == [*docs.columns, "rank_"] and sorted(r["rank_"] for r in drawn.collect()) == list(range(1, len(ROWS) + 1))
    assert resample.resample(docs.limit(0), bench.limit(0)).count() == 0
    groups = docs.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") != 3, F.col("doc_id").cast("string"))})
    got = divergence.audit(groups, least_docs=2).collect()
    assert {r["source"] for r in got if r["part"] == "pair"} == {"", "1", "2", "4", "5", "6"} and sum(r["part"] == "pair" for r in got) == 30
    turns = docs.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(None).cast("bigint"), "role": F.lit(None).cast("string")})
    windows = chat.windows(turns, VOCABULARY).collect()
    assert sum(r["n_turns"] for r in windows) == len(ROWS) and {r["conv_id"] for r in windows} == {i for i, _ in ROWS}


def test_results_of_edge_rows(docs, bench):
    lines = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).where("doc_id in (1, 2, 3, 6)").collect()}
    assert lines == {1: None, 2: "", 3: LONG.split("\n")[0] + "\n", 6: " \n\t "}
    hits = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()}
    assert hits[3, 264_000] == 264_000 and hits[1, 0] == hits[6, 0] == 0 and hits[4, 10] == 10
    links = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.classes(docs).collect()}
    assert links[4, 6] == links[5, 6] == 4 and links[5, 5] == 4 and links[1, 0] == 1 and links[None, 6] is None


def test_every_stage_of_the_pipeline(spark, docs, bench, labels, tmp_path):
    import corpus_pipeline

    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids <= {i for i, _ in ROWS}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name == "line dedup":
            assert ids == {None, 1, 2, 3, 4, 5, 6}
        elif name == "n-gram Jaccard join":
            assert ids == {None, 1, 2, 3, 4, 6}
        elif name == "benchmark decontamination":
            assert ids == {None, 1, 2, 5, 6}
        elif name == "byte-level BPE":
            assert out.count() == len(ROWS)
