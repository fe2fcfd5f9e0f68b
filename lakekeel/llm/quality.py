"""Operator 5: quality classifier from weak labels.

Method. Overlapping heuristic labellers vote good, bad or nothing on every document. The counts of vote patterns
over all documents (a small table) go into an expectation-maximisation that estimates, without labels, the class
shares and each labeller's accuracy. The resulting posterior labels train a hashed linear scorer (words hashed into
2^HASH_BITS weights, and the votes), which then scores every document. There are two such models: low quality, and
toxic. A document is kept if neither scorer rejects it.

Toxicity needs words that a heuristic cannot guess in every language. Beside a fixed list of insults, some of its labellers look for stems (or words) that
mark toxic rows in a bounded sample of labelled rows (LABELLED_ROWS, those with the smallest hash of their id): a greedy cover takes,
one by one, the stem with the largest log-likelihood ratio of rows that hold it at least twice, over the toxic rows that no stem explains yet, so that
copies of one text add no words of their own. Scorers train on TRAIN_ROWS documents chosen alike. Vote counts cover all documents.

Defined cases: null or wordless text gets no votes, scores as such and is rejected as low quality; any length; repeated rows get the
same result; labels with null ids or values are ignored, repeated labels count once by id (toxic if any says so);
without labels only the fixed words are known; empty tables give an empty result; all columns pass through `keep`.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, folded_words, ship, utf8

#: Bounds of the two samples that are fitted on, in rows.
LABELLED_ROWS, TRAIN_ROWS = 20_000, 4_000
#: Least log-likelihood ratio of a stem.
STEM_EVIDENCE = 14.0
#: Bytes of a word's stems.
STEM_BYTES = (4, 5, 6, 7, 8)
#: Words of a window in which distinct words are counted.
WINDOW = 400
HASH_BITS = 15
EPOCHS, RATE, DECAY = 12, 0.5, 1e-4

# Insults in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard bitch asshole jerk freak retard slut whore cretin filth vermin degenerate dimwit halfwit "
    "dummkopf trottel arschloch schlampe hurensohn wichser abschaum vollidiot schwachkopf "
    "connard connasse salaud salope crétin enculé débile abruti ordure "
    "imbécil estúpido estúpida pendejo cabrón gilipollas basura escoria".encode().split()
)

GOOD, BAD, NONE = 0, 1, 2

# Classes of bytes: letters, capitals, digits, spaces, sentence marks, further marks, non-ASCII.
_LOWER, _UPPER, _DIGIT, _SPACE, _SENTENCE, _MARK, _PIPE, _BANG, _WIDE = range(9)
_CLASS = np.full(256, _MARK, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = _WIDE
    elif _c.islower():
        _CLASS[_b] = _LOWER
    elif _c.isupper():
        _CLASS[_b] = _UPPER
    elif _c.isdigit():
        _CLASS[_b] = _DIGIT
    elif _c in " \t\n\r\v\f":
        _CLASS[_b] = _SPACE
    elif _c in ".,;:?'\"-()":
        _CLASS[_b] = _SENTENCE
    elif _c == "|":
        _CLASS[_b] = _PIPE
    elif _c == "!":
        _CLASS[_b] = _BANG


def _vote(bad: bool) -> int:
    return BAD if bad else NONE


def smoothed(count: int, n: int, usual: float, weight: int) -> float:
    """A share drawn towards the usual one, as if `weight` more items had it: few items are little evidence."""
    return (count + usual * weight) / (n + weight)


def quality_votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Marks among letters, words that end in doubled marks, capitals, words in capitals, repeated neighbours, few
    distinct words, table bars, exclamation marks, few short words; and good: all of these well inside the usual.
    All shares are over the whole text; that of distinct words, which falls with length, is the mean of consecutive
    windows of WINDOW words, weighted by their lengths."""
    n = len(words)
    if not n:
        return (BAD,) * QUALITY_LABELLERS
    raw = np.frombuffer(text, np.uint8)
    classes = _CLASS[raw]
    c = np.bincount(classes, minlength=9)
    letters, ascii_letters = int(c[_LOWER] + c[_UPPER] + c[_WIDE]), int(c[_LOWER] + c[_UPPER])
    marks, capitals = smoothed(int(c[_MARK]), letters, 0.01, 40), smoothed(int(c[_UPPER]), ascii_letters, 0.05, 40)
    twice = smoothed(sum(map(operator.eq, words, words[1:])), n, 0.0, 10)
    short = smoothed(sum(map((4).__gt__, map(len, words))), n, 0.15, 10)
    distinct = smoothed(sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)), n, 0.8, 10)
    doubled = smoothed(doubled_ends(raw, classes), n, 0.0, 3)
    shouted = smoothed(sum(map(bytes.isupper, words)), n, 0.0, 10)
    bars, bangs = smoothed(int(c[_PIPE]), n, 0.0, 3), smoothed(int(c[_BANG]), n, 0.0, 3)
    usual = marks < 0.03 and capitals < 0.25 and twice < 0.08 and distinct > 0.3 and bars < 0.08 and bangs < 0.15 and short > 0.05 and doubled < 0.05 and shouted < 0.1
    return (
        _vote(marks > 0.06), _vote(doubled > 0.15), _vote(capitals > 0.40), _vote(shouted > 0.25), _vote(twice > 0.15), _vote(distinct < 0.2),
        _vote(bars > 0.15), _vote(bangs > 0.3), _vote(short < 0.03), GOOD if usual else NONE,
    )


QUALITY_LABELLERS, TOXIC_LABELLERS = 10, 5
_DOUBLED = np.zeros(256, bool)
_DOUBLED[list(b"*$%&#!~^=+_@")] = True


def doubled_ends(raw: np.ndarray, classes: np.ndarray) -> int:
    """Words of three bytes or more that end in a doubled mark."""
    at = np.flatnonzero((raw[2:] == raw[1:-1]) & _DOUBLED[raw[2:]]) + 2
    at = at[classes[at - 2] != _SPACE]
    return int((np.append(classes, _SPACE)[at + 1] == _SPACE).sum())


class Words(dict):
    """A code for each word: its hash bucket, and above it a bit for an insult and one for a learnt stem. Remembered up to `cap`
    words, so memory stays bounded."""

    def __init__(self, stems: frozenset[bytes], cap: int = 300_000):
        super().__init__()
        self.stems, self.cap = stems, cap

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.cap:
            self.clear()
        stems = self.stems
        learnt = bool(stems) and (word in stems or not stems.isdisjoint([word[:k] for k in STEM_BYTES if len(word) > k]))
        value = self[word] = bucket(word) | (word in INSULTS) << HASH_BITS | learnt << HASH_BITS + 1
        return value

    def codes(self, text: bytes | None) -> np.ndarray:
        words = folded_words(text or b"")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def toxic_votes(codes: np.ndarray) -> tuple[int, ...]:
    """Known insults, and places of these or of words with a learnt stem: more than a few for the length, several, many; and good: next to none. One
    place in a long text is little evidence, since a stem also comes up by chance."""
    marks = np.bincount(codes >> HASH_BITS, minlength=4)
    insults, learnt = int(marks[1] + marks[3]), int(marks[2] + marks[3])
    most = max(insults, learnt)
    share = smoothed(most, len(codes), 0.0, 10)
    return _vote(insults > 0), _vote(share > 0.004), _vote(most > 1 and share > 0.003), _vote(share > 0.01), GOOD if share < 0.002 else NONE


def fit_accuracies(patterns: dict[tuple[int, ...], int], prior_bad: float, rounds: int = 60) -> tuple[float, np.ndarray]:
    """EM over vote patterns. Gives the share of bad documents and P(vote | class) as (labeller, class, vote)."""
    votes = np.array(list(patterns), np.int64)
    count = np.array(list(patterns.values()), np.float64)
    m = votes.shape[1]
    table = np.empty((m, 2, 3))
    table[:, GOOD], table[:, BAD] = (0.60, 0.02, 0.38), (0.05, 0.40, 0.55)
    share = prior_bad
    for _ in range(rounds):
        posterior = posteriors(votes, share, table)
        share = min(max(float((posterior * count).sum() / count.sum()), 1e-4), 0.5)
        for k in range(m):
            for v in range(3):
                at = votes[:, k] == v
                table[k, BAD, v] = (posterior * count)[at].sum() + 0.5
                table[k, GOOD, v] = ((1 - posterior) * count)[at].sum() + 0.5
        table /= table.sum(axis=2, keepdims=True)
    return share, table


def posteriors(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """P(bad | votes) with independent labellers."""
    logs = np.log(table)
    rows = np.arange(votes.shape[1])
    odds = math.log(share / (1 - share)) + (logs[rows, BAD, votes] - logs[rows, GOOD, votes]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << HASH_BITS) - 1)


def word_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with counts over the number of words: part of a vector of length at most one."""
    at, counts = np.unique(codes & ((1 << HASH_BITS) - 1), return_counts=True)
    return at, counts / (len(codes) or 1)


class Scorer:
    """Hashed linear scorer: logit = bias + votes' weights + mean weight of the words."""

    def __init__(self, labellers: int):
        self.votes = np.zeros((labellers, 3))
        self.words = np.zeros(1 << HASH_BITS)
        self.bias = 0.0

    def fit(self, rows: list[tuple[tuple[int, ...], np.ndarray, np.ndarray]], target: np.ndarray) -> Scorer:
        """Logistic regression on soft labels; each class weighs the same."""
        share = min(max(float(target.mean()) if len(target) else 0.5, 0.02), 0.98)
        k = np.arange(self.votes.shape[0])
        order = np.random.default_rng(5)
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for i in order.permutation(len(rows)):
                votes, at, value = rows[i]
                logit = self.bias + self.votes[k, votes].sum() + float(self.words[at] @ value)
                y = target[i]
                weight = 0.5 * y / share + 0.5 * (1 - y) / (1 - share)
                step = rate * min(weight, 5.0) * (y - 1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))))
                self.bias += 0.1 * step
                self.votes[k, votes] += step
                self.words[at] += step * value - rate * DECAY * self.words[at]
        return self

    def score(self, votes: tuple[int, ...], buckets: np.ndarray) -> float:
        """P(bad)."""
        total = float(self.words[buckets].mean()) if len(buckets) else 0.0
        logit = self.bias + sum(self.votes[i, v] for i, v in enumerate(votes)) + total
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))


def cover(stems: list[bytes], holders: list[list[int]], others: list[int], n_toxic: int, n_other: int) -> frozenset[bytes]:
    """Stems by a greedy cover of the toxic rows. holders: the toxic rows of each stem; others: how many other rows have it."""
    rows, at = np.unique(np.array([r for h in holders for r in h], np.int64), return_inverse=True)
    of = np.repeat(np.arange(len(stems)), [len(h) for h in holders])
    other = np.array(others, np.float64) + 0.5
    base = n_toxic / (n_toxic + n_other + 0.5)
    open_rows = np.ones(len(rows), bool)
    chosen: list[bytes] = []
    while stems:
        found = np.bincount(of[open_rows[at]], minlength=len(stems)).astype(np.float64)
        share = found / (found + other)
        good = share > max(base, 0.3)
        evidence = np.where(good, found * np.log(np.where(good, share, 1) / base) + other * np.log(np.where(good, 1 - share, 1) / (1 - base)), 0)
        best = int(evidence.argmax())
        if evidence[best] < STEM_EVIDENCE:
            break
        chosen.append(stems[best])
        open_rows[at[of == best]] = False
    return frozenset(chosen)


def learnt_stems(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> frozenset[bytes]:
    """Stems that mark the toxic rows of the labelled sample, where they occur twice or more; what is gathered is bounded by the sample."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).withColumnRenamed("doc_id", "labelled_id")
    own_docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = own_docs.join(F.broadcast(sample), F.col("i") == F.col("labelled_id"))
    rows = rows.groupBy("labelled_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), (F.max("is_toxic") > 0).alias("toxic")).select("t", "toxic")  # one row an id, however many it has

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        other: Counter = Counter()
        holders: dict[bytes, set[int]] = {b"": set()}
        for batch in batches:
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                counts: Counter = Counter()
                for word, n in Counter(folded_words(text or b"")).items():
                    for stem in {word, *(word[:k] for k in STEM_BYTES if len(word) > k)}:
                        counts[stem] += n
                stems = [b"", *(stem for stem, n in counts.items() if n > 1)]
                if toxic:
                    row = xxhash.xxh3_64_intdigest(text or b"") >> 1  # equal texts are one row
                    for stem in stems:
                        holders.setdefault(stem, set()).add(row)
                else:
                    other.update(stems)
        stems = [*holders.keys() | other.keys()]
        yield {"stem": stems, "rows": [sorted(holders.get(s, ())) for s in stems], "other": [other[s] for s in stems]}

    sums = arrow_map(rows, step, "stem binary, rows array<bigint>, other bigint").groupBy("stem").agg(F.array_distinct(F.flatten(F.collect_list("rows"))).alias("rows"), F.sum("other").alias("other"))
    got = sums.where((F.size("rows") >= 4) & (F.size("rows") * 2 >= F.col("other")) | (F.length("stem") == 0)).orderBy("stem").toArrow()
    stems, holders, others = (got.column(i).to_pylist() for i in range(3))
    if not stems or stems[0] != b"":
        return frozenset()
    return cover(stems[1:], holders[1:], others[1:], len(holders[0]), others[0])


def patterns(docs: DataFrame, stems: frozenset[bytes], text_col: str) -> tuple[dict, dict]:
    """Counts of vote patterns over all documents, for quality and for toxicity."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter = Counter()
        words = Words(stems)
        for batch in batches:
            for text in utf8(batch.column(0)):
                counts[0, quality_votes(text or b"", (text or b"").split())] += 1
                counts[1, toxic_votes(words.codes(text))] += 1
        yield {"model": [m for m, _ in counts], "votes": ["".join(map(str, v)) for _, v in counts], "n": [*counts.values()]}

    out: tuple[dict, dict] = {}, {}
    for r in arrow_map(docs.select(text_col), step, "model int, votes string, n bigint").groupBy("model", "votes").agg(F.sum("n").alias("n")).orderBy("model", "votes").collect():
        out[r["model"]][tuple(map(int, r["votes"]))] = r["n"]
    return out


class Model:
    def __init__(self, stems: frozenset[bytes], quality: Scorer, toxic: Scorer):
        self.stems, self.quality, self.toxic = stems, quality, toxic

    def judge(self, text: bytes | None, words: Words) -> tuple[float, float, bool]:
        """P(low quality), P(toxic), kept."""
        text = text or b""
        plain = text.split()
        if not plain:
            return 1.0, 0.0, False
        codes = words.codes(text)
        buckets = codes & ((1 << HASH_BITS) - 1)
        low = self.quality.score(quality_votes(text, plain), buckets)
        toxic = self.toxic.score(toxic_votes(codes), buckets)
        return low, toxic, low < 0.5 and toxic < 0.5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    stems = learnt_stems(docs, labels, id_col, text_col)
    quality, toxic = patterns(docs, stems, text_col)
    ids = docs.select(F.col(id_col).alias("train_id")).where("train_id is not null").distinct().orderBy(F.xxhash64("train_id"), "train_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), F.col("i") == F.col("train_id"))
    rows = rows.groupBy("train_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"))  # one row an id, however many it has

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = Words(stems)
        for batch in batches:
            out: dict = {"id": batch.column(0), "quality": [], "toxic": [], "at": [], "value": []}
            for text in utf8(batch.column(1)):
                codes = words.codes(text)
                at, value = word_features(codes)
                out["quality"].append(quality_votes(text or b"", (text or b"").split()))
                out["toxic"].append(toxic_votes(codes))
                out["at"].append(at.astype(np.int16 if HASH_BITS < 16 else np.int32).tobytes())
                out["value"].append(value.astype(np.float32).tobytes())
            yield out

    id_type = docs.schema[id_col].dataType.simpleString()
    got = arrow_map(rows, step, f"id {id_type}, quality array<int>, toxic array<int>, at binary, value binary").toArrow()
    order = np.argsort(np.array([str(i) for i in got.column("id").to_pylist()])) if got.num_rows else []
    at = [np.frombuffer(b, np.int16 if HASH_BITS < 16 else np.int32).astype(np.int64) for b in got.column("at").to_pylist()]
    value = [np.frombuffer(b, np.float32).astype(np.float64) for b in got.column("value").to_pylist()]
    scorers = []
    for name, counts, prior in (("quality", quality, 0.1), ("toxic", toxic, 0.1)):
        votes = [tuple(v) for v in got.column(name).to_pylist()]
        scorer = Scorer(QUALITY_LABELLERS if name == "quality" else TOXIC_LABELLERS)
        if counts and votes:
            share, table = fit_accuracies(counts, prior)
            target = posteriors(np.array(votes), share, table)
            scorer.fit([(votes[i], at[i], value[i]) for i in order], target[order])
        scorers.append(scorer)
    return Model(stems, *scorers)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Columns: id_col, low_quality, toxicity (scores 0 to 1, rounded to 6 places), keep."""
    model = model or fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = Words(shared.value.stems)
        for batch in batches:
            judged = [shared.value.judge(t, words) for t in utf8(batch.column(1))]
            yield {id_col: batch.column(0), "low_quality": [round(j[0], 6) for j in judged], "toxicity": [round(j[1], 6) for j in judged], "keep": [j[2] for j in judged]}

    return arrow_map(docs.select(id_col, text_col), step, f"{id_col} {id_type}, low_quality double, toxicity double, keep boolean")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.stems)
        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([shared.value.judge(t, words)[2] for t in texts], pa.bool_()))

    return ship(docs).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
