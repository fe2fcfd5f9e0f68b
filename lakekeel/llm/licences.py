"""Operator 4: licence scans with a positional rare-token index.

Method. The phrases, notices and whole licence texts form an index from a template's rarest word to (template, position in it); that of a
notice is the rarest of its mandatory key phrase, so that no notice which counts is missed.
Rarity is measured on the corpus: the document frequencies of the templates' words over all documents. For a
file, its words that the index holds, that is its highest-IDF licence words, are looked up; each posting gives
a start for its template, starts are intersected with the template's other words by relative position, and a notice
counts only if its mandatory key phrase stands in its place. From the key phrase on, both ways, the notice's words are taken in order; up to GAP words that are
put in, left out or replaced are stepped over.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A base phrase needs all its words. A notice needs
NOTICE_SHARE of its words and its key phrase; the score is the largest share found (1 for a base phrase).

Defined cases: null text counts as empty (no words, null places, empty labels, score 0); any length; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, folded_words, utf8
from .licence_texts import BASE, SHORT, WHOLE

NOTICES = (*SHORT, *((label, " ".join(w.decode() for w in folded_words(text.encode())), key) for label, text, key in WHOLE))

NOTICE_SHARE = 0.75
#: Words in a row that may differ between a notice and a file.
GAP = 3


def in_order(template: list[bytes], words: Sequence[bytes]) -> int:
    """How many of a template's words stand in order at the beginning of words. At a difference the nearest place goes on
    where both agree again, with at most GAP words left out on either side; the words beside it are skipped."""
    i = j = same = 0
    while i < len(template) and j < len(words):
        if template[i] == words[j]:
            i, j, same = i + 1, j + 1, same + 1
            continue
        steps = ((x, far - x) for far in range(1, 2 * GAP + 1) for x in range(max(0, far - GAP), min(far, GAP) + 1))
        agree = (s for s in steps if i + s[0] < len(template) and j + s[1] < len(words) and template[i + s[0]] == words[j + s[1]])
        x, y = next(agree, (1, 1))
        i, j = i + x, j + y
    return same


class LicenceIndex:
    def __init__(self, idf: dict[bytes, float], base=BASE, notices=NOTICES):
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        for label, phrase, key in [(b, p, None) for b, p in base] + list(notices):
            words = phrase.encode().split()
            at = None
            if key is not None:
                k = key.encode().split()
                at = next((i, i + len(k)) for i in range(len(words)) if words[i : i + len(k)] == k)
            number = len(self.templates)
            self.templates.append((label, words, at))
            # every phrase or notice that counts holds all these words in their places, so one of them finds it
            first, last = at or (0, len(words))
            place = min(range(first, last), key=lambda i: (-idf[words[i]], words[i]))
            self.postings.setdefault(words[place], []).append((number, place))
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base places, base labels, all labels, score."""
        places, base_labels, labels, score = [], set(), set(), 0.0
        if self.anchors.isdisjoint(words):
            return places, base_labels, labels, score
        postings, n = self.postings, len(words)
        starts = {(t, i - o) for i, w in enumerate(words) if w in postings for t, o in postings[w]}
        for t, start in sorted(starts):
            label, template, key = self.templates[t]
            if key is None:
                if start >= 0 and words[start : start + len(template)] == template:
                    places.append(start)
                    base_labels.add(label)
                    labels.add(label)
                    score = 1.0
                continue
            a, b = start + key[0], start + key[1]
            if a < 0 or b > n or words[a:b] != template[key[0] : key[1]]:
                continue
            reach = 2 * len(template)
            after = in_order(template[key[1] :], words[b : b + reach])
            before = in_order(template[: key[0]][::-1], words[max(0, a - reach) : a][::-1])
            share = (key[1] - key[0] + after + before) / len(template)
            score = max(score, share)
            if share >= NOTICE_SHARE:
                labels.add(label)
        return places, base_labels, labels, score


def licence_idf(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, float]:
    """IDF of the templates' words over all documents; one row a word and task is gathered."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in utf8(batch.column(0)):
                counts.update(vocabulary.intersection(folded_words(text or b"")))
        yield {"word": [*counts, b""], "df": [*counts.values(), rows]}

    got = arrow_map(docs.select(text_col), step, "word binary, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {bytes(r["word"]): r["df"] for r in got}
    total = df.get(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def scan_licences(docs: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    id_type = docs.schema[id_col].dataType.simpleString()
    vocabulary = frozenset(w for t in [*base, *notices] for w in t[1].encode().split())
    index = LicenceIndex(licence_idf(docs, vocabulary, text_col), base, notices)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                words = folded_words(text or b"")
                places, base_labels, labels, score = index.scan(words)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score))
            yield {id_col: batch.column(0)} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    return arrow_map(docs.select(id_col, text_col), step, f"{id_col} {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
