"""Operator 10: token counts by a linear longest-match automaton.

Method. The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces that
are popped on taking it, both computed beforehand, so that greedy longest-match-first segmentation of a word
takes one pass over its bytes and yields the number of pieces without building any. Words are runs of
characters other than ASCII white space; each is matched with one leading space, which pieces that begin a
word carry. The automaton is built once and broadcast; the vocabulary bounds its size. Words met again in a task are
answered from a bounded memo.

Defined cases: null text counts as empty (0 words, 0 tokens); a byte that starts no piece makes its whole
word one unknown piece, as greedy word pieces do; any text length, one word of any length included (the pass is
linear); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import vocabulary
from .common import arrow_map, utf8


class LongestMatch:
    """Greedy longest-match piece counts in linear time."""

    def __init__(self, vocabulary: Iterable[bytes], memo: int = 200_000):
        go: dict[int, int] = {}  # child by node << 8 | byte; children have larger numbers than their parents
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                child = go.get(node << 8 | byte)
                if child is None:
                    child = go[node << 8 | byte] = len(final)
                    final.append(False)
                node = child
            final[node] = node != 0
        self.go = go
        # fail[v]: where the rest stands after popping pops[v] pieces from the text of v; -1 if that cannot be
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for edge, child in go.items():
            children[edge >> 8].append((edge & 255, child))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                if final[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    at, count = self.fail[node], self.pops[node]
                    while at >= 0 and at << 8 | byte not in go:
                        count += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = go[at << 8 | byte], count
                queue.append(child)
        self.memo: dict[bytes, int] = {}
        self.cap = memo

    def count(self, word: bytes) -> int:
        """Pieces of the word; one if it cannot be cut."""
        child, fail, pops = self.go.get, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (nxt := child(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = nxt
        while node:  # the rest
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total

    def remembered(self, word: bytes) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.cap:
                self.memo.clear()
            got = self.count(b" " + word)
            if len(word) <= 64:
                self.memo[word] = got
        return got


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id_col, n_words, n_tokens (pieces), n_unsplit (words of one piece), longest (most pieces in a word)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary(path)[0]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter = shared.value
        for batch in batches:
            out: dict = {id_col: batch.column(0), "n_words": [], "n_tokens": [], "n_unsplit": [], "longest": []}
            for text in utf8(batch.column(1)):
                counts = list(map(counter.remembered, (text or b"").split()))
                out["n_words"].append(len(counts))
                out["n_tokens"].append(sum(counts))
                out["n_unsplit"].append(counts.count(1))
                out["longest"].append(max(counts, default=0))
            yield out

    return arrow_map(docs.select(id_col, text_col), step, f"{id_col} {id_type}, n_words bigint, n_tokens bigint, n_unsplit bigint, longest bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"))
