"""Operator 9: exact n-gram Jaccard join by vertical partitioning.

Method. A text's set is its distinct 5-word shingles, as 64-bit hashes; equal sets are one class. All shingles have one
global order: by the number of sets that hold them, then by hash; the most frequent ones (a broadcast list of fixed size)
come last, by rank. (1) Shingles are dealt by hash into fragments, which count their sets; shingles of one set
only can be in no overlap, so only shared ones go back to their set. A set with too few shared shingles links
with nothing. (2) Two sets that link share a shingle among the first ones of each in the global order; there the
shingles that follow bound the overlap from above. (3) For candidate pairs the order is cut at fixed frequencies; each
cut counts its part of the overlap, and the parts are summed per pair. (4) Links join classes into components.

No group is expanded into all its pairs. Members of a prefix group are first compared with one of them, the one with the smallest
share of shingles of its own, which tends to be the text that the others were copied from, and is the same in all
groups of a family: at most one pair for each prefix entry. Then links are contracted, and in groups that hold several components,
sketches of the members are compared block by block; only pairs of different components whose sketches allow the
threshold come out and are counted. This loses no component: a pair inside one component changes nothing.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. A text of fewer words than a shingle has its whole sequence
as the one shingle; one without words (or null) has none and links with nothing.

Defined cases: rows with equal doc_id stand for one node, whatever their texts; a null doc_id has its own size and a null component;
a row without words keeps its own id; repeated rows give repeated results; any length; empty tables give an empty result;
other columns are ignored. Equality of shingles and sets is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashMemo, arrow_map, materialise, mix64, utf8
from .graph import components

SHINGLE = 5
#: Link threshold in percent.
PERCENT = 80
#: Frequent shingles that come last in the order: at most so many are gathered and broadcast.
FREQUENT = 1 << 15
#: Per task, so many of its most frequent shingles take part in the count of these.
FREQUENT_OF_TASK = 2048
#: Shingles and sets that a task holds before it deals them out as one block.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 1 << 16
#: Shingles of a fragment of the order, on average; their number is counted, so a task's share stays the same at any size.
FRAGMENT_SHINGLES = 1 << 22
#: Where the order is cut for the overlaps: numbers of sets that hold a shingle, then the frequent ones.
CUTS = (3, 6, 1 << 31)
#: Parts of the hash range in the sketch of a set's shared shingles.
SKETCH = 128
#: Pairs that are counted side by side with one set, and members of a prefix group that meet at a time.
CELL_PAIRS, CELL_MEMBERS = 64, 256
#: Members whose sketches are compared with a block at a time.
ROWS = 64

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, memo: HashMemo, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * _MUL + h[i : i + n]
    if len(h) < k:
        out += np.uint64(len(h))
    return np.unique(mix64(out))


def class_id(own: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall into each of SKETCH parts of the hash range (255: that or more)."""
    part = own >> np.uint64(64 - SKETCH.bit_length() + 1)
    return np.minimum(np.bincount(part.astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def most_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds from above on the overlaps of sets, from their sketches (along the last axis)."""
    low = np.minimum(x, y)
    return np.where((low == 255).any(axis=-1), np.int64(1) << 40, low.sum(axis=-1, dtype=np.int64))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (kind 0: doc, n, c) and of frequent shingles (kind 1: c the shingle, n its documents in the task)."""
    id_type = docs.schema[docs.columns[0]].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo, held, size = HashMemo(), [], 0

        def frequent() -> dict:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            top = np.flatnonzero(n >= 3)
            top = top[np.argsort(-n[top], kind="stable")][:FREQUENT_OF_TASK]
            return {"kind": [1] * len(top), "doc": pa.nulls(len(top), pa.null()), "n": n[top].astype(np.int64), "c": h[top].astype(np.int64)}

        for batch in batches:
            rows = [shingles(t, memo, k) for t in utf8(batch.column(1))]
            yield {"kind": [0] * len(rows), "doc": batch.column(0), "n": [len(r) for r in rows], "c": [class_id(r) for r in rows]}
            for row in rows:
                held.append(row)
                size += len(row)
                if size > 2 * BLOCK_SHINGLES:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return arrow_map(docs, step, f"kind int, doc {id_type}, n bigint, c bigint")


def frequent_shingles(made: DataFrame):
    """The broadcast list of frequent shingles: sorted hashes, and the rank of each (rising with its documents)."""
    top = made.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n"), "c").limit(FREQUENT).toArrow()
    hot, count = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy()
    by_hash = np.argsort(hot)
    rank = np.empty(len(hot), np.uint32)
    rank[np.lexsort((hot, count))] = np.arange(len(hot))
    return made.sparkSession.sparkContext.broadcast((hot[by_hash], rank[by_hash]))


def lanes(values: np.ndarray) -> bytes:
    """64-bit integers, byte by byte: zero bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unlanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()


def dealt(docs: DataFrame, frequent, k: int, fragments: int) -> DataFrame:
    """Rows (fragment, kind, block, payload). Kind 0: a block's shingles in a fragment, each with the number of its set
    in the block. Kind 1: the block's sets, with their frequent shingles; these pass through any fragment.
    fragments is a power of two."""
    shift = np.uint64(64 - fragments.bit_length() + 1)
    most = min(max(BLOCK_SHINGLES, 16 * fragments), 4 * BLOCK_SHINGLES)  # so that a block has several in each fragment

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo, seen = HashMemo(), set()
        hot, rank = frequent.value
        task, blocks = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> dict:
            block = task << 32 | blocks
            c, n, rare, common, ranks = zip(*held)
            h = np.concatenate(rare)
            order = np.argsort(h)
            number = np.repeat(np.arange(len(held)), [len(r) for r in rare]).astype(np.uint16)[order]
            h = h[order]
            fragment = (h >> shift).astype(np.int64) if fragments > 1 else np.zeros(len(h), np.int64)
            begin = np.flatnonzero(np.diff(fragment, prepend=-1))
            delta = np.diff(h, prepend=np.uint64(0))
            delta[begin] = h[begin]
            ends = [*begin[1:].tolist(), len(h)] if len(begin) else []
            payloads = [lanes(delta[a:b]) + number[a:b].tobytes() for a, b in zip(begin.tolist(), ends)]
            counts = np.array([len(x) for x in common], np.uint32)
            head = [np.array([len(held)], np.uint64), np.array(c, np.int64), np.array(n, np.int64), counts, np.concatenate(common), np.concatenate(ranks)]
            where = fragment[begin].tolist()
            return {
                "fragment": [*where, (31 * task + blocks) % fragments], "kind": [0] * len(where) + [1], "block": [block] * (len(where) + 1),
                "payload": [*payloads, b"".join(x.tobytes() for x in head)],
            }

        for batch in batches:
            for text in utf8(batch.column(0)):
                own = shingles(text, memo, k)
                if not len(own) or (c := class_id(own)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                n, common, ranks = len(own), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    here = hot[at] == own
                    if here.any():
                        own, common, ranks = own[~here], own[here], rank[at[here]]
                held.append((c, n, own, common, ranks))
                size += n
                if size >= most or len(held) == BLOCK_SETS:
                    yield flush()
                    held.clear()
                    size, blocks = 0, blocks + 1
        if held:
            yield flush()

    return arrow_map(docs, step, "fragment int, kind int, block bigint, payload binary")


def shared_shingles(entries: DataFrame) -> DataFrame:
    """Rows (block, kind, payload). Kind 0: those of a block's shingles in a fragment that more sets hold, with their number of sets. entries
    come sorted by fragment."""

    def finish(held: list[tuple[int, bytes]]) -> dict:
        sizes = [len(p) // 10 for _, p in held]
        h = np.concatenate([np.cumsum(unlanes(p, n), dtype=np.uint64) for (_, p), n in zip(held, sizes)])
        number = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for (_, p), n in zip(held, sizes)])
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
        count = np.diff(np.concatenate([begin, [len(h)]]))
        of = np.repeat(count, count)
        more = of > 1
        keep, level = order[more], np.minimum(of[more], (1 << 31) - 1).astype(np.uint32)
        back = np.argsort(keep)  # by block again
        keep, level = keep[back], level[back]
        cut = np.searchsorted(keep, np.cumsum([0, *sizes]))
        out: dict = {"block": [], "kind": [], "payload": []}
        for (block, _), a, b in zip(held, cut[:-1].tolist(), cut[1:].tolist()):
            if a < b:
                out["block"].append(block)
                out["kind"].append(0)
                out["payload"].append(h[keep[a:b]].tobytes() + level[a:b].tobytes() + number[keep[a:b]].tobytes())
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, held = None, []
        for batch in batches:
            for fragment, kind, block, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == 1:
                    yield {"block": [block], "kind": [1], "payload": [payload]}
                    continue
                if fragment != current and held:
                    yield finish(held)
                    held = []
                current = fragment
                held.append((block, payload))
        if held:
            yield finish(held)

    return arrow_map(entries, step, "block bigint, kind int, payload binary")


def linkable(parts: DataFrame, percent: int) -> DataFrame:
    """Rows (c, n, own, sketch, prefix, cuts, body) of the classes with enough shared shingles; own is the number of the others. body: the
    shared ones in the global order; cuts: how many lie before each cut; prefix: those that can be the first common
    one. parts come sorted by block; a class comes once for each block that holds it."""

    def finish(head: bytes, held: list[bytes]) -> dict:
        m = int(np.frombuffer(head, np.uint64, 1)[0])
        c, n = np.frombuffer(head, np.int64, m, 8), np.frombuffer(head, np.int64, m, 8 + 8 * m)
        counts = np.frombuffer(head, np.uint32, m, 8 + 16 * m)
        hot = int(counts.sum(dtype=np.int64))
        at = 8 + 20 * m
        h, level, number = [np.frombuffer(head, np.uint64, hot, at)], [np.frombuffer(head, np.uint32, hot, at + 8 * hot) + np.uint32(1 << 31)], [np.repeat(np.arange(m), counts)]
        for p in held:
            k = len(p) // 14
            h.append(np.frombuffer(p, np.uint64, k))
            level.append(np.frombuffer(p, np.uint32, k, 8 * k))
            number.append(np.frombuffer(p, np.uint16, k, 12 * k))
        h, level, number = np.concatenate(h), np.concatenate(level), np.concatenate(number).astype(np.int64)
        order = np.lexsort((h, level, number))
        h, level = h[order], level[order]
        shared = np.bincount(number, minlength=m)
        ends = np.cumsum(shared)
        out: dict = {x: [] for x in ("c", "n", "own", "sketch", "prefix", "cuts", "body")}
        for i in np.flatnonzero((100 * shared >= percent * n) & (shared > 0)).tolist():
            a, b, size = int(ends[i] - shared[i]), int(ends[i]), int(n[i])
            own = size - (b - a)
            least = -(-percent * size // 100)  # of its shingles, in any overlap that links
            out["c"].append(int(c[i]))
            out["n"].append(size)
            out["own"].append(own)
            out["sketch"].append(sketch(h[a:b]))
            out["prefix"].append(h[a : a + size - least + 1 - own].astype(np.int64))
            out["cuts"].append(np.searchsorted(level[a:b], np.array(CUTS, np.uint32)).astype(np.int32))
            out["body"].append(h[a:b].tobytes())
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, head, held = None, None, []
        for batch in batches:
            for block, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != current and head is not None:
                    yield finish(head, held)
                    head, held = None, []
                current = block
                if kind == 1:
                    head = payload
                else:
                    held.append(payload)
        if head is not None:
            yield finish(head, held)

    return arrow_map(parts, step, "c bigint, n bigint, own bigint, sketch binary, prefix array<bigint>, cuts array<int>, body binary")


def _possible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """The shingles from the first common one on suffice for a link."""
    return F.lit(100 + percent) * F.least(na - pa_, nb - pb) >= F.lit(percent) * (na + nb)


def centre_pairs(members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of each member of a prefix group with the group's centre."""
    met = members.join(groups.select("h", "centre"), "h").where(F.col("c") != F.col("centre.c"))
    good = met.where(_possible(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos"), percent))
    return good.select(F.least("c", "centre.c").alias("a"), F.greatest("c", "centre.c").alias("b")).distinct()


def promising(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with their sizes, without those whose sketches rule the threshold out."""
    left = known.select(F.col("c").alias("a"), F.col("n").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = known.select(F.col("c").alias("b"), F.col("n").alias("size_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = batch.filter(pa.array((100 + percent) * most_common(x, y) >= percent * total))
            yield {name: keep.column(i) for i, name in enumerate(("a", "b", "size_a", "size_b"))}

    return arrow_map(both, step, "a bigint, b bigint, size_a bigint, size_b bigint")


def linked(likely: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold: overlaps by cut of the order, summed per pair. A pair goes to the end with
    more pairs, in cells of about CELL_PAIRS, so a set travels once for each cell that asks for it."""
    n_parts = int(likely.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degree = materialise(likely.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("d")))
    both = likely.join(degree.select(F.col("c").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("c").alias("b"), F.col("d").alias("db")), "b")
    to_a = F.col("da") >= F.col("db")
    both = both.withColumn("hub", F.when(to_a, F.col("a")).otherwise(F.col("b"))).withColumn("other", F.when(to_a, F.col("b")).otherwise(F.col("a")))
    salt = F.pmod(F.xxhash64("other"), F.ceil(F.greatest("da", "db") / CELL_PAIRS).cast("bigint"))
    both = materialise(both.select("a", "b", "size_a", "size_b", "hub", salt.alias("salt")))
    cuts = len(CUTS) + 1
    cut = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut")
    none = F.lit(None)
    asked = both.select("hub", "salt", cut, F.lit(1).alias("kind"), "a", "b", "size_a", "size_b", none.cast("binary").alias("segment"))
    needed = both.select(F.explode(F.array("a", "b")).alias("c"), "hub", "salt").distinct()
    bounds = [F.lit(0), *[F.get("cuts", F.lit(i)) for i in range(cuts - 1)], F.length("body") / 8]
    segments = F.posexplode(F.array(*[F.substring("body", (lo * 8 + 1).cast("int"), ((hi - lo) * 8).cast("int")) for lo, hi in zip(bounds, bounds[1:])]))
    given = known.select("c", "cuts", "body").join(needed, "c").select("hub", "salt", "c", segments.alias("cut", "segment"))
    given = given.select("hub", "salt", "cut", F.lit(0).alias("kind"), F.col("c").alias("a"), *[none.cast("bigint").alias(x) for x in ("b", "size_a", "size_b")], "segment")
    met = given.unionByName(asked).repartition(n_parts, "hub", "salt", "cut").sortWithinPartitions("hub", "salt", "cut", "kind")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, own = None, {}
        for batch in batches:
            out: dict = {"a": [], "b": [], "size_a": [], "size_b": [], "part": []}
            for hub, salt, at, kind, a, b, size_a, size_b, segment in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (hub, salt, at) != current:
                    current, own = (hub, salt, at), {}
                if kind == 0:
                    own[a] = np.frombuffer(segment, np.uint64)
                else:
                    part = len(np.intersect1d(own[a], own[b], assume_unique=True))
                    for name, value in zip(out, (a, b, size_a, size_b, part)):
                        out[name].append(value)
            yield out

    partial = arrow_map(met, count, "a bigint, b bigint, size_a bigint, size_b bigint, part bigint")
    total = partial.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("size_a").alias("sa"), F.first("size_b").alias("sb"))
    return total.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sa") + F.col("sb") - F.col("both"))).select("a", "b")


def apart_pairs(members: DataFrame, groups: DataFrame, parts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components in a prefix group whose sketches allow the threshold. A group's members meet in
    cells, each for two blocks of about CELL_MEMBERS of them."""
    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = members.join(groups.where("k > 2").select("h", "k"), "h")  # a pair is compared already
    own = own.join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    own = materialise(own)
    mixed = own.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    own = own.join(mixed, "h", "left_semi").join(known.select("c", "sketch"), "c")
    blocks = F.ceil(F.col("k") / CELL_MEMBERS).cast("int")
    own = own.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = own.select("h", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "c", "n", "pos", "component", "sketch")
    cells = cells.repartition(n_parts, "h", "x", "y").sortWithinPartitions("h", "x", "y")

    def finish(x: int, y: int, rows: list[tuple]) -> Iterator[dict]:
        block, c, n, pos, component = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        sketches = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, SKETCH)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        rest = n - pos
        for s in range(0, len(left), ROWS):
            i = left[s : s + ROWS, None]
            good = (component[i] != component[right]) & ((100 + percent) * np.minimum(rest[i], rest[right]) >= percent * (n[i] + n[right]))
            p, q = np.nonzero(good & (i < right) if x == y else good)
            p, q = left[s + p], right[q]
            if len(p):
                good = (100 + percent) * most_common(sketches[p], sketches[q]) >= percent * (n[p] + n[q])
                a, b = c[p[good]], c[q[good]]
                yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, rows = None, []
        for batch in batches:
            for h, x, y, *row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (h, x, y) != current and rows:
                    yield from finish(*current[1:], rows)
                    rows = []
                current = (h, x, y)
                rows.append(row)
        if rows:
            yield from finish(*current[1:], rows)

    return arrow_map(cells, step, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Columns: id_col, n_shingles, component_id (smallest id reachable by links, the row's own included)."""
    spark = docs.sparkSession
    own = docs.select(id_col, text_col)
    made = materialise(sets(own, k))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = made.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    fragments = 1 << max(6, (4 * n_parts - 1).bit_length(), (shingles // FRAGMENT_SHINGLES).bit_length())
    entries = dealt(own.select(text_col), frequent_shingles(made), k, fragments).repartition(n_parts, "fragment").sortWithinPartitions("fragment", "block")
    parts = shared_shingles(entries).repartition(n_parts, "block").sortWithinPartitions("block", "kind")
    known = materialise(linkable(parts, percent))
    once = materialise(known.groupBy("c").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")))
    members = materialise(once.select("c", "n", "own", F.posexplode("prefix").alias("i", "h")).select("h", "c", "n", "own", (F.col("own") + F.col("i")).alias("pos")))
    centre = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "c", "n", "pos")).alias("centre")
    groups = materialise(members.groupBy("h").agg(F.count("*").alias("k"), centre).where("k > 1"))
    members = members.drop("own")
    pairs = materialise(centre_pairs(members, groups, percent))
    links = materialise(linked(materialise(promising(pairs, once, percent)), known, percent))
    rest = materialise(apart_pairs(members, groups, components(links), once, percent).join(pairs, ["a", "b"], "left_anti"))
    more = linked(materialise(promising(rest, once, percent)), known, percent)
    # a doc_id with several texts joins their classes
    rows = made.where("kind = 0 and n > 0 and doc is not null")
    texts = rows.groupBy("doc").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    twice = rows.join(texts, "doc").where("c <> lo").select(F.col("lo").alias("a"), F.col("c").alias("b"))
    parts = components(links.unionByName(more).unionByName(twice))
    # smallest document of each class, then of each component; a set without shingles links with nothing
    least = materialise(rows.groupBy("c").agg(F.min("doc").alias("least")))
    spread = least.join(parts.withColumnRenamed("node", "c"), "c")
    of_part = spread.groupBy("component").agg(F.min("least").alias("least"))
    of_class = materialise(
        least.join(spread.select("c"), "c", "left_anti").select("c", "least").unionByName(spread.select("c", "component").join(of_part, "component").select("c", "least"))
    )
    # each row with shingles meets its class; AQE splits classes of very many copies
    rows = made.where("kind = 0").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "c")
    joined = rows.join(of_class, (rows["c"] == of_class["c"]) & (rows["n_shingles"] > 0), "left")
    return joined.select(
        rows[id_col], "n_shingles", F.when(rows[id_col].isNull(), F.lit(None)).otherwise(F.coalesce("least", rows[id_col])).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest of their component; all columns stay."""
    kept = materialise(classes(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct())
    return docs.join(kept, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE = f"""
with recursive doc as (select doc_id, {_WORDS_SQL} as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from doc where len(w) > 0)),
sized as (select doc_id, count(*) as n from sh group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as both_n from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by all),
link as (select a, b from common join sized p on p.doc_id = a join sized q on q.doc_id = b where 100 * both_n >= 80 * (p.n + q.n - both_n)),
edge as (select a, b from link union select b, a from link),
walk(doc_id, seen) as (select a, a from edge union select e.b, w.seen from walk w join edge e on e.a = w.doc_id)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, coalesce(r.least_id, d.doc_id) as component_id
from doc d left join sized s using (doc_id) left join (select doc_id, min(seen) as least_id from walk group by doc_id) r using (doc_id)
"""
