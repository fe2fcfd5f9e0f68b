"""Operator 13: source divergence audit over a k-squared tree of group and term counts.

Method. Every (lang, source) group has a row, every kept term of the lang a column of a count matrix that is almost all zero. Columns are
dealt by a hash of the term into blocks of about `WIDTH`, frequent terms first; rows are numbered by size and cut into bands of `BAND`. A
task holds the nonzero entries of one block and one or two bands as k-squared trees (k = 2): a level's bitmap says which
quadrants hold anything, down to dense leaves of 8 by 8. The trees of two bands are walked together, level by level, for all pairs of row
quadrants at once. Where both quadrants of a pair are all zero the walk ends: both groups have the smoothed share of a zero count
there, so the divergence is a constant times the number of such columns, and is added in one multiplication a pair when
the blocks' sums meet. Only leaves with an entry on either side are computed. What leaves a task is a row for each pair of groups.

Shares are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals; (p - q)^2 fits 64 bits since p is at most 10^9 + 1.

Scale: terms are counted in the tasks before the shuffle, so a hot source sends at most a row for each term and task; the terms of a group are
cut to the ten best of each task before they meet. The pairs of a lang's sources are the result itself and grow with its square.

Defined cases: null text has no terms, null lang and source are ''; repeated rows count as documents each; a group
without terms is there with its zeros; a lang that keeps no term has value 0 for all pairs and no term rows; texts of any length are taken whole; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialise, utf8

LEAST_DOCS = 10
TOP = 10
#: Terms of a block, groups of a band, rows and columns of a leaf.
WIDTH, BAND, LEAF = 2048, 128, 8
#: Counted (group, term) pairs that a task holds before it sends them on.
HELD = 300_000
#: Byte map of the contract's terms: what is no letter and not part of a non-ASCII code point becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences, and documents with the term; the row without a term counts the group's documents."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        uses: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}
        size = 0

        def give() -> dict:
            out: dict = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
            for (lang, source), counts in uses.items():
                own = seen[lang, source]
                out["lang"] += [lang] * len(counts)
                out["source"] += [source] * len(counts)
                out["term"] += [t if t is None else t.decode() for t in counts]
                out["n"] += counts.values()
                out["docs"] += [own[t] for t in counts]
            return out

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.translate(LETTERS).split() if text else []
                use = uses.setdefault((lang, source), Counter())
                own = seen.setdefault((lang, source), Counter())
                before = len(use)
                use.update(words)
                use[None] += 0
                own.update(set(words))
                own[None] += 1
                size += len(use) - before
                if size > HELD:
                    yield give()
                    uses.clear()
                    seen.clear()
                    size = 0
        yield give()

    named = docs.select(F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[source_col], F.lit("")).alias("source"), docs[text_col].alias("text"))
    partial = arrow_map(named, step, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class QuadTree:
    """A k-squared tree, k = 2, over `size` by `size` cells: which quadrants of each level hold an entry, and the leaves."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, rest: np.ndarray, size: int):
        """rest: the value of a row's other cells."""
        self.size = size
        self.depth = (size // LEAF).bit_length() - 1
        side = size // LEAF
        self.width = [side >> (self.depth - d) for d in range(self.depth + 1)]
        leaf = (rows // LEAF) * side + cols // LEAF
        self.leaves, index = np.unique(leaf, return_inverse=True)
        self.levels = [self.leaves]
        for d in range(self.depth, 0, -1):
            r, c = self.levels[0] // self.width[d], self.levels[0] % self.width[d]
            self.levels.insert(0, np.unique((r >> 1) * self.width[d - 1] + (c >> 1)))
        bands = np.zeros(-(-max(1, len(rest)) // LEAF) * LEAF, np.int64)
        bands[: len(rest)] = rest
        self.rest = bands.reshape(-1, LEAF)
        self.tiles = np.repeat(self.rest[self.leaves // side][:, :, None], LEAF, axis=2) if len(self.leaves) else np.zeros((0, LEAF, LEAF), np.int64)
        self.tiles[index, rows % LEAF, cols % LEAF] = values

    def at(self, level: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Index of each quadrant in its level, -1 where it is all zero."""
        found, codes = self.levels[level], rows * self.width[level] + cols
        if not len(found):
            return np.full(len(codes), -1)
        place = np.minimum(np.searchsorted(found, codes), len(found) - 1)
        return np.where(found[place] == codes, place, -1)

    def tile(self, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaves' values; an all-zero leaf has its rows' rest."""
        out = np.repeat(self.rest[np.minimum(rows, len(self.rest) - 1)][:, :, None], LEAF, axis=2)
        there = place >= 0
        out[there] = self.tiles[place[there]]
        return out


def walk(a: QuadTree, b: QuadTree, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of rows of two trees of one size: the sum of (p - q)^2 / (p + q) over the columns of the leaves where either has an entry,
    and the number of these columns. If b is a, only pairs with the smaller row quadrant first."""
    ra = rb = c = np.zeros(1, np.int64)
    for level in range(1, a.depth + 1):
        i, j, k = (np.array(x) for x in zip(*[(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)], strict=True))
        ra, rb, c = ((2 * x[:, None] + y).ravel() for x, y in ((ra, i), (rb, j), (c, k)))
        some = (a.at(level, ra, c) >= 0) | (b.at(level, rb, c) >= 0)
        if b is a:
            some &= ra <= rb
        some &= (ra < len(a.rest)) & (rb < len(b.rest))
        ra, rb, c = ra[some], rb[some], c[some]
    sums = np.zeros((len(a.rest), len(b.rest), LEAF, LEAF), np.int64)
    touched = np.zeros((len(a.rest), len(b.rest)), np.int64)
    order = np.lexsort((rb, ra))
    ra, rb, c = ra[order], rb[order], c[order]
    for at in range(0, len(ra), 4096):
        x, y, z = ra[at : at + 4096], rb[at : at + 4096], c[at : at + 4096]
        p, q = a.tile(a.at(a.depth, x, z), x)[:, :, None, :], b.tile(b.at(b.depth, y, z), y)[:, None, :, :]
        real = (z[:, None] * LEAF + np.arange(LEAF) < n_cols)[:, None, None, :]
        f = np.where(real, (p - q) ** 2 // np.maximum(p + q, 1), 0).sum(axis=3)
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        sums[x[starts], y[starts]] += np.add.reduceat(f, starts)
        touched[x[starts], y[starts]] += np.add.reduceat(np.minimum(LEAF, n_cols - z * LEAF), starts)
    rows = (len(a.rest) * LEAF, len(b.rest) * LEAF)
    return sums.transpose(0, 2, 1, 3).reshape(rows), touched.repeat(LEAF, 0).repeat(LEAF, 1)


def _share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exact; null if there are no terms."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div nullif(cast({n} + 2 * {v} as decimal(20,0)), 0)")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(docs: DataFrame, least_docs: int = LEAST_DOCS, width: int = WIDTH, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v, g: number in its lang, p0: share of a zero count), and entries (lang, source, g, term, block, col, cols: columns
    of the block, p, q: the lang's share). Both are written tables."""
    counted = materialise(term_counts(docs, text_col, lang_col, source_col))
    known = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = materialise(known.drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    blocks = kept.join(langs, "lang").withColumn("block", F.expr(f"pmod(xxhash64(term), 1 + v div {width})"))
    blocks = blocks.repartition("lang", "block")  # else the window below would stay with the join's tasks, one a lang
    here = Window.partitionBy("lang", "block")
    order = here.orderBy(F.desc("total"), "term")
    terms = materialise(blocks.select("lang", "term", "block", "v", (F.row_number().over(order) - 1).alias("col"), F.count("*").over(here).alias("cols"), _share("total", "lang_n", "v").alias("q")))
    found = materialise(counted.join(terms, ["lang", "term"]))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").fillna(0, ["group_n", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("group_n"), "source")) - 1
    groups = materialise(groups.withColumn("g", number).withColumn("p0", _share("0", "group_n", "v")))
    entries = found.drop("v").join(groups.select("lang", "source", "g", "group_n", "v"), ["lang", "source"]).withColumn("p", _share("n", "group_n", "v"))
    return groups, materialise(entries.select("lang", "source", "g", "term", "block", "col", "cols", "p", "q"))


def pair_sums(groups: DataFrame, entries: DataFrame, band: int = BAND) -> DataFrame:
    """Rows (lang, a, b, value, touched), a < b: what the leaves of all blocks give for each pair of groups, and how many columns these hold."""
    banded = groups.where("v > 0").withColumn("band", F.expr(f"g div {band}"))
    rests = banded.groupBy("lang", "band").agg(F.array_sort(F.collect_list(F.struct("g", "p0"))).alias("rest"))  # a band is bounded
    last = banded.groupBy("lang").agg(F.max("band").alias("last"))
    dealt = entries.withColumn("band", F.expr(f"g div {band}")).join(last, "lang")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).withColumns({"lo": F.least("band", "other"), "hi": F.greatest("band", "other")})
    cells = dealt.groupBy("lang", "block", "lo", "hi").agg(F.max("cols").alias("cols"), F.collect_list(F.struct("g", "col", "p")).alias("cells"))
    for side in ("lo", "hi"):
        cells = cells.join(rests.select("lang", F.col("band").alias(side), F.col("rest.p0").alias(f"rest_{side}")), ["lang", side])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            row = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                flat = row["cells"][i].values
                g, col, p = (np.asarray(flat.field(n)).astype(np.int64) for n in ("g", "col", "p"))
                lo, hi, cols = (row[n][i].as_py() for n in ("lo", "hi", "cols"))
                size = 1 << (max(band, cols, LEAF) - 1).bit_length()
                trees = []
                for number, side in ((lo, "rest_lo"), (hi, "rest_hi")):
                    mine = g // band == number
                    trees.append(QuadTree(g[mine] - number * band, col[mine], p[mine], np.asarray(row[side][i].values, np.int64), size))
                    if lo == hi:
                        trees *= 2
                        break
                sums, touched = walk(*trees, cols)
                a, b = np.nonzero(touched)
                real = (a < len(row["rest_lo"][i])) & (b < len(row["rest_hi"][i])) & ((lo < hi) | (a < b))
                a, b = a[real], b[real]
                yield {"lang": [row["lang"][i].as_py()] * len(a), "a": a + lo * band, "b": b + hi * band, "value": sums[a, b], "touched": touched[a, b]}

    made = arrow_map(cells.select("lang", "cols", "lo", "hi", "cells", "rest_lo", "rest_hi"), step, "lang string, a bigint, b bigint, value bigint, touched bigint")
    return made.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH, band: int = BAND, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part `pair`: the other sources of the lang by divergence; part `term`: the `top`
    terms that a source uses more than its lang does."""
    groups, entries = shares(docs, least_docs, width, text_col, lang_col, source_col)
    one = groups.select("lang", "source", "g", "p0", "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("g2"), F.col("p0").alias("q0"))
    both = one.join(two, "lang").where("g <> g2").withColumns({"a": F.least("g", "g2").cast("bigint"), "b": F.greatest("g", "g2").cast("bigint")})
    summed = both.join(pair_sums(groups, entries, band), ["lang", "a", "b"], "left").fillna(0, ["value", "touched"])
    zeros = F.when(F.col("v") > 0, (F.col("v") - F.col("touched")) * _gap("p0", "q0")).otherwise(0)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + zeros).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


_SHARE = "1 + (1000000000::hugeint * ({} + 2)) // ({} + 2 * v)"
ORACLE = f"""
with doc as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents),
tok as (select r, lang, source, unnest(w) as term from doc),
kept as (select lang, term, count(*) as total from tok group by lang, term having count(distinct r) >= {LEAST_DOCS}),
langs as (select lang, count(*) as v, sum(total) as lang_n from kept group by lang),
cnt as (select lang, source, term, count(*) as n from tok join kept using (lang, term) group by lang, source, term),
grp as (
  select d.lang, d.source, coalesce(v, 0) as v, coalesce(group_n, 0) as group_n
  from (select distinct lang, source from doc) d left join langs using (lang) left join (select lang, source, sum(n) as group_n from cnt group by lang, source) using (lang, source)),
p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, {_SHARE.format("coalesce(n, 0)", "group_n")} as p, {_SHARE.format("total", "lang_n")} as q
  from grp g join kept k using (lang) join (select lang, lang_n from langs) using (lang) left join cnt using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
         left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= {TOP}
"""
