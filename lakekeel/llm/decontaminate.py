"""Operator 2: benchmark decontamination with a generalised suffix automaton.

Method. The normalised items form one suffix automaton over words. A text's words stream through it; at each
word the automaton gives the longest match that ends there. A match of at least 13 words covers its words (each
of its 13-word parts is a window of some item); an item of fewer words counts where all of it occurs. Items are
read from the automaton's states: the state of the last 13 words knows all items with this window.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A text is contaminated if it has hit words
and at least one in twenty of its words is hit.

One automaton holds SHARD_BYTES of item text at most, and only one is broadcast at a time. A benchmark of more text takes a
pass over the documents for each automaton; the passes write the spans of the documents that are hit, which are then merged by document.

Defined cases: null text has no words (n_words 0, not contaminated); null or wordless items are ignored; repeated
items count by item_id; any text length; empty tables give empty or clean results; further columns of the
documents pass through `clean` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, folded_words, fresh, materialise, ship, utf8

WINDOW = 13
#: Text bytes of benchmark items per automaton (a longer item has one of its own).
SHARD_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Of the word sequences of items: longest matches, windows and whole short items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._annotate(items)

    def _state(self, go: dict, link: int, length: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state reached from p by word, cut to the length of p plus one."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.go[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.go[last]:  # this prefix is already known from another item
            return self._split(last, word, self.go[last][word])
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.go[p]:
            self.go[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.go[p][word])
        return new

    def _annotate(self, items: list[tuple[object, list[bytes]]]) -> None:
        n = len(self.go)
        holders: list[set] = [set() for _ in range(n)]  # items in which a state's words occur
        self.short: list[list[tuple[int, object]]] = [[] for _ in range(n)]  # whole items below the window
        for item, words in items:
            state = 0
            for word in words:
                state = self.go[state][word]
                up = state
                while up > 0 and item not in holders[up]:
                    holders[up].add(item)
                    up = self.link[up]
            if 0 < len(words) < self.window:
                self.short[state].append((len(words), item))
        # by length: links point to shorter states
        self.items_at: list[frozenset | None] = [None] * n
        self.next_short = [0] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= self.window:
                self.items_at[state] = frozenset(holders[state]) if self.length[up] < self.window else self.items_at[up]
            self.next_short[state] = state if self.short[state] else self.next_short[up]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged spans [first word, past last word] that are hit, and the items of the windows there."""
        go, link, length, window = self.go, self.link, self.length, self.window
        next_short, short, items_at, root = self.next_short, self.short, self.items_at, self.go[0]
        spans: list[list[int]] = []
        items: set = set()
        state = size = 0
        for i, word in enumerate(words):
            if state:
                nxt = go[state].get(word)
                if nxt is None:
                    while state and nxt is None:
                        state = link[state]
                        nxt = go[state].get(word)
                    size = length[state]
                if nxt is None:
                    state = size = 0
                    continue
                state, size = nxt, size + 1
            else:
                state = root.get(word, 0)
                if not state:
                    continue
                size = 1
            cover = 0
            if size >= window:
                cover = size
                items |= items_at[state]
            at = next_short[state]
            while at:
                for n, item in short[at]:
                    if n <= size:
                        items.add(item)
                        cover = max(cover, n)
                at = next_short[link[at]]
            if cover:
                merge_span(spans, i + 1 - cover, i + 1)
        return spans, items


def merge_span(spans: list[list[int]], first: int, past: int) -> None:
    """Add a span that ends at or after all others."""
    while spans and spans[-1][1] >= first:
        first = min(first, spans.pop()[0])
    spans.append([first, past])


def shards_of(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items, dealt by id into tables of about SHARD_BYTES of text."""
    own = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // SHARD_BYTES) or 1
    return [own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else own for k in range(n)]


def automaton(shard: DataFrame, window: int):
    """The broadcast automaton of one shard."""
    rows = sorted(((r["i"], folded_words(r["t"].encode())) for r in shard.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    return shard.sparkSession.sparkContext.broadcast(SuffixAutomaton([r for r in rows if r[1]], window))


def merged(parts: list[list[list[int]]]) -> list[list[int]]:
    """Spans of several automata as one list."""
    spans: list[list[int]] = []
    for first, past in sorted((s for own in parts for s in own), key=lambda s: (s[1], s[0])):
        merge_span(spans, first, past)
    return spans


def hit_documents(docs: DataFrame, shards: list[DataFrame], window: int, key: str, text_col: str) -> DataFrame:
    """Rows (key, parts, items) of the documents that are hit, from a pass for each shard."""

    def scanned(shard: DataFrame) -> DataFrame:
        shared = automaton(shard, window)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                out: dict = {"key": [], "spans": [], "items": []}
                for at, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    spans, found = shared.value.scan(folded_words(text or b""))
                    if spans:
                        out["key"].append(at)
                        out["spans"].append(spans)
                        out["items"].append(sorted(map(str, found)))
                yield out

        got = materialise(arrow_map(docs.select(key, text_col), step, "key bigint, spans array<array<bigint>>, items array<string>").distinct())
        shared.destroy()
        return got

    every = scanned(shards[0])
    for shard in shards[1:]:
        every = every.unionByName(scanned(shard))
    return every.groupBy("key").agg(F.collect_list("spans").alias("parts"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def with_hits(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str):
    """The documents, and a function of (words, parts, items) that gives a document's spans and items. With one automaton the documents
    come as they are; else two columns, parts and items, follow theirs."""
    shards = shards_of(items, item_col, item_text)
    if len(shards) == 1:
        shared = automaton(shards[0], window)
        return docs, lambda words, parts, found: shared.value.scan(words)
    key, parts, found = fresh(docs.columns, "hit_key", "hit_parts", "hit_items")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    hits = materialise(hit_documents(keyed, shards, window, key, text_col)).select(F.col("key").alias(key), F.col("parts").alias(parts), F.col("items").alias(found))
    joined = keyed.join(hits, key, "left").select(*docs.columns, parts, found)
    return joined, lambda words, parts, found: (merged(parts or []), set(found or ()))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words, past the last one)."""
    rows, find = with_hits(docs.select(id_col, text_col), items, window, id_col, text_col, item_col, item_text)
    id_type = docs.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {id_col: batch.column(0), "n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "spans": []}
            for text, hits in zip(utf8(batch.column(1)), hits_of(batch, 2)):
                words = folded_words(text or b"")
                spans, found = find(words, *hits)
                hit = sum(b - a for a, b in spans)
                out["n_words"].append(len(words))
                out["n_hit"].append(hit)
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
                out["contaminated"].append(hit > 0 and 20 * hit >= len(words))
                out["spans"].append(spans)
            yield out

    return arrow_map(rows, step, f"{id_col} {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<array<bigint>>")


def hits_of(batch: pa.RecordBatch, own: int) -> Iterator[tuple]:
    """The columns that with_hits put after the `own` ones of the documents, or nothing."""
    if batch.num_columns == own:
        return repeat((None, None))
    return zip(batch.column(own).to_pylist(), batch.column(own + 1).to_pylist())


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without contaminated ones; from the others the hit spans are cut. All columns stay."""
    rows, find = with_hits(docs, items, window, id_col, text_col, item_col, item_text)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = hits_of(batch, n)
            batch = batch.select(range(n))
            at = batch.schema.get_field_index(text_col)
            texts, keep, changed = utf8(batch.column(at)), [], False
            for k, (text, own) in enumerate(zip(texts, hits)):
                words = folded_words(text or b"")
                spans, _ = find(words, *own)
                hit = sum(b - a for a, b in spans)
                if not hit or 20 * hit < len(words):
                    keep.append(k)
                if hit and 20 * hit < len(words):
                    places = [m.span() for m in _WORD.finditer(text)]
                    cut, left = [], 0
                    for a, b in spans:
                        cut.append(text[left : places[a][0]])
                        left = places[b - 1][1]
                    texts[k], changed = b"".join(cut) + text[left:], True
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type))
            yield batch.take(pa.array(keep, pa.int64()))

    return ship(rows).mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("spans")


_FOLD_SQL = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
with doc as (select doc_id, {_FOLD_SQL.format("coalesce(text, '')")} as w from documents),
item as (select item_id, {_FOLD_SQL.format("coalesce(text, '')")} as w from benchmark),
sized as (select item_id, w, least(len(w), {WINDOW}) as n from item where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
sizes as (select distinct n from win),
doc_win as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc join sizes on len(w) >= n)),
hit as (select distinct doc_id, item_id, n, i from doc_win join win using (n, g)),
words_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by doc_id),
items_hit as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct doc_id, cast(item_id as varchar) as k from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join words_hit using (doc_id) left join items_hit using (doc_id)
"""
