"""Operator 11: target-distribution importance resampling.

Method. Features of a text are its runs of 1 to `runs` consecutive words, hashed into `buckets`. Two passes over a table's texts count
each bucket, summed in every task before the shuffle; what comes out is one array of gains, as long as there are buckets, in which every
feature of a document is looked up and added to its weight. Noise drawn from the id turns weights into keys whose largest are a
sample without replacement. The key of the last document drawn is found without sorting all of them: each block of remaining keys
(`BLOCK` of them at most) gives its median, the medians weighted by the sizes of their blocks have a median themselves, and that pivot
leaves at least about a quarter of the remaining keys on either side, so one side goes in every round. Only the winners are sorted; their ranks come
from their places in the sorted partitions and the sizes of these.

Defined cases: null and empty texts have no features and weight 0; a null id is hashed as the empty string and comes after all others among equal scores;
repeated rows count and are drawn each for itself; texts of any length are taken whole; without documents the result is empty, and without target
texts T is 0; names of further columns may be anything.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, folded_words, fresh, materialise, utf8

RUNS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
#: Keys of which one median is taken.
BLOCK = 1 << 20
#: Remaining keys that one task sorts to end the selection.
FEW = 1 << 16
_LAST = (1 << 63) - 1


def feature_buckets(words: list[bytes], runs: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to `runs` words."""
    n = sum(max(0, len(words) - r) for r in range(runs))
    texts = words if runs == 1 else (b" ".join(words[i : i + r]) for r in range(1, runs + 1) for i in range(len(words) - r + 1))
    return np.fromiter(map(zlib.crc32, texts), np.int64, n) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Every task sends the counts of its buckets once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                if text:
                    total += np.bincount(feature_buckets(folded_words(text), runs, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield {"bucket": used, "n": total[used]}

    out = np.zeros(buckets, np.int64)
    counted = arrow_map(texts.select(text_col), step, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the raw texts, each smoothed by one."""
    size = len(raw)
    ratio = (target + 1.0) * (float(raw.sum()) + size) / ((raw + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(key: object, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score), with the columns `carry` in front as c0, c1, ..."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (*carry, id_col)]
    names = [*[f"c{i}" for i in range(len(carry))], "id"]
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        gain = shared.value
        for batch in batches:
            out: dict = {n: batch.column(i) for i, n in enumerate(names)} | {"n_words": [], "n_features": [], "weight": [], "score": []}
            for key, text in zip(batch.column(len(carry)).to_pylist(), utf8(batch.column(len(carry) + 1)), strict=True):
                words = folded_words(text or b"")
                found = feature_buckets(words, runs, len(gain))
                weight = int(gain[found].sum())
                out["n_words"].append(len(words))
                out["n_features"].append(len(found))
                out["weight"].append(weight)
                out["score"].append(weight + noise(key, seed))
            yield out

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", n_words bigint, n_features bigint, weight bigint, score bigint"
    return arrow_map(docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate((*carry, id_col, text_col))]), step, schema)


def _after(key: tuple[int, int]):
    """Keys (down, tie) beyond this one."""
    return (F.col("down") > key[0]) | ((F.col("down") == key[0]) & (F.col("tie") > key[1]))


def _upto(key: tuple[int, int]):
    return ~_after(key)


def weighted_median(rows: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Of (down, tie, n) rows, the key at which half of the n are reached."""
    rows = sorted(rows)
    half, seen = sum(n for *_, n in rows) / 2, 0
    for down, tie, n in rows:
        seen += n
        if seen >= half:
            break
    return down, tie


def cutoff(keys: DataFrame, k: int, block: int = BLOCK, few: int = FEW) -> tuple[int, int]:
    """The k-th key, from 1, of a written table of keys (down, tie), both bigint, in ascending order.

    Each round is one pass over the table: tasks give the median and the size of each block of remaining keys. The driver holds one row a
    block or partition.
    """

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        size = 0

        def give() -> dict:
            both = np.concatenate(held)
            order = np.lexsort((both[:, 1], both[:, 0]))
            middle = both[order[(len(both) - 1) // 2]]
            return {"down": [int(middle[0])], "tie": [int(middle[1])], "n": [len(both)]}

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                held.append(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1))
                size += part.num_rows
                if size >= block:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    left = keys.select("down", "tie")
    n = left.count()
    while n > few:
        pivot = weighted_median([tuple(r) for r in arrow_map(left, medians, "down bigint, tie bigint, n bigint").collect()])
        low = left.where(_upto(pivot)).count()
        if k <= low:
            same = left.where((F.col("down") == pivot[0]) & (F.col("tie") == pivot[1])).count()
            if k > low - same:
                return pivot
            left, n = left.where(_upto(pivot) & ~((F.col("down") == pivot[0]) & (F.col("tie") == pivot[1]))), low - same
        else:
            left, n, k = left.where(_after(pivot)), n - low, k - low
    row = left.orderBy("down", "tie").offset(k - 1).limit(1).first()
    return row["down"], row["tie"]


def with_rank(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """All rows of `scored` with `rank`, 1, 2, 3... by score for the `percent` of the rows of enough words that are drawn, else null."""
    table = materialise(scored.withColumn("down", -F.col("score")).withColumn("tie", F.coalesce(F.col("id").cast("bigint"), F.lit(_LAST))))
    enough = F.col("n_words") >= least_words
    k = percent * table.where(enough).count() // 100
    none = F.lit(None).cast("bigint").alias("rank")
    if k == 0:
        return table.select("*", none).drop("down", "tie")
    last = cutoff(table.where(enough), k, block, few)
    won = enough & _upto(last)
    order = ["down", "tie", "n_features", "weight", "row"]  # the row only parts repeated rows over tasks
    inside = table.where(won).withColumn("row", F.monotonically_increasing_id()).orderBy(*order).withColumn("place", F.monotonically_increasing_id()).drop("row")
    placed = materialise(inside)
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranked.withColumn("rank", F.when(rank <= k, rank))
    out = [*scored.columns, "rank"]
    return ranked.select(*out).unionByName(table.where(~won).select("*", none).select(*out))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The documents drawn, all their columns, with the rank as `rank` (another name if that is taken). Ids are integers."""
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, text_col, runs, buckets))
    ranked = with_rank(scores(docs, gain, id_col, text_col, runs, seed, tuple(docs.columns)), percent, least_words)
    (name,) = fresh(docs.columns, "rank")
    return ranked.where("rank is not null").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("rank").alias(name))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ranked = with_rank(scores(docs, gains(bucket_counts(docs), bucket_counts(target))))
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
with crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, j: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as t),
raw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
word as (select r, unnest(w) as word from raw),
target as (select unnest({_WORDS}) as word from benchmark),
listed as (select distinct word from (select word from word union all select word from target)),
hashed as (
  select word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: cast('0x' || h[i:i + 1] as bigint))), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % {BUCKETS} as bucket
  from (select word, hex(encode(word)) as h from listed), crc),
s as (select bucket, count(*) as n from word join hashed using (word) group by bucket),
t as (select bucket, count(*) as n from target join hashed using (word) group by bucket),
sums as (select (select count(*) from word) as big_s, (select count(*) from target) as big_t),
gain as (
  select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (big_s + {BUCKETS}) / ((coalesce(s.n, 0) + 1.0::double) * (big_t + {BUCKETS})))) as bigint) as g
  from (select distinct bucket from hashed) left join s using (bucket) left join t using (bucket), sums),
weighed as (select r, sum(g) as weight from word join hashed using (word) join gain using (bucket) group by r),
scored as (
  select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || sha256('{SEED}:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from raw left join weighed using (r)),
enough as (select *, row_number() over (order by score desc, doc_id) as n, {PERCENT} * count(*) over () // 100 as k from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when n <= k then n end as rank from enough
union all
select doc_id, n_features, weight, score, null from scored where n_features < {LEAST_WORDS}
"""
