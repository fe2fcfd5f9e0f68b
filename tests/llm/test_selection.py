"""Operators 11 to 13 against brute force, with nulls, repeats, long texts, empty tables, odd columns, and small blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lakekeel.llm import chat, divergence, resample, wordpiece
from lakekeel.llm.bpe import vocabulary
from lakekeel.llm.common import materialise

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ka", "lo", "mé", "漢", "q7", "Zu") for b in ("x", "ta", "ß", "RO", "3")]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(r.choices(words, weights, k=r.choice([0, 3, 19, 20, 40, 90]))) for _ in range(n)]


# ---- operator 11


def brute_resample(rows, target, percent=10, least=20):
    split = lambda t: WORD.findall(lower(t))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in split(x)), Counter(bucket(w) for x in target for w in split(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in set(s) | set(t)}
    out = []
    for key, x in rows:
        words = split(x)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in words)
        out.append([key, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def test_resample_equals_brute_force(spark, tmp_path):
    rows = list(enumerate(texts(900, 1))) + [(None, None), (1000, ""), (1001, "word " * 60_000), (7, texts(1, 2)[0]), (None, "Some words of a document without an id, and " * 3)]
    target = [*texts(40, 3), None, ""]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("id", "score", "rank", "down", "n_words")}).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resample.op11_resample(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample(rows, target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    drawn = resample.resample(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert drawn.columns == [*docs.columns, "rank_"]
    by_rank = {r["rank_"]: (r["doc_id"], r["text"]) for r in drawn.collect()}
    assert {k: v[0] for k, v in by_rank.items()} == {r[4]: r[0] for r in want if r[4]}
    assert all((k, t) in rows for k, t in by_rank.values())


def test_resample_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample.resample(empty, empty).count() == 0
    one = spark.createDataFrame([(5, "same words " * 20)] * 400 + [(None, "same words " * 20)] * 3, "doc_id bigint, text string").repartition(6)
    assert sorted(r["rank"] for r in resample.resample(one, empty).collect()) == list(range(1, 41))
    assert resample.resample(one, empty, runs=3).first()["rank"] == 1
    words = [b"a", b"b", b"a"]
    assert list(resample.feature_buckets(words, 2, 97)) == [zlib.crc32(x) % 97 for x in (b"a", b"b", b"a", b"a b", b"b a")]


@pytest.mark.parametrize("spread", [3, 1_000_000])
def test_cutoff_finds_every_key(spark, spread):
    r = random.Random(spread)
    rows = [(r.randrange(-spread, spread), r.randrange(50)) for _ in range(3000)]
    keys = materialise(spark.createDataFrame(rows, "down bigint, tie bigint").repartition(7))
    for k in (1, 2, 299, 1500, 2999, 3000):
        assert resample.cutoff(keys, k, block=100, few=20) == sorted(rows)[k - 1]


# ---- operator 12


def conversations():
    r = random.Random(9)
    odd = ["", None, "<|im_end|>\n<|im_start|>assistant\nno", "<\\|x", "a\\<\\\\|<<|", "漢字 😀 é", "x\n\ny\n", "<|im_end|>\n" * 40]
    rows = []
    for conv in [None, -1, *range(40)]:
        n = r.choice([1, 2, 5, 8, 60])
        for turn in range(n):
            role = "system" if turn == 0 and r.random() < 0.6 else r.choice(["user", "assistant", "assistant", None, "tool\nx", "a\\nb"])
            text = r.choice(odd) if r.random() < 0.2 else " ".join(r.choices(["some", "words", "for", "turns", "Überlänge"], k=r.choice([2, 20, 90])))
            rows.append((conv, turn, role, text))
    rows += [(3, None, "user", "no number"), (3, 1, "user", "twice"), (3, 1, "user", "twice"), (4, 9, "assistant", "long " * 30_000), (4, 10, "user", "after")]
    return rows


def grouped(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    return {c: [(role, text) for _, (_, role), (_, text) in sorted(x)] for c, x in out.items()}


def test_chat_read_back_equals_the_turns(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    want = grouped([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: r for r in chat.op12_chat(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), conv
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_windows(turns, count, budget, history, segment):
    """(context, new) pairs of turn numbers, chosen turn by turn."""
    size = [count(*t) for t in turns]
    start = [sum(size[:i]) for i in range(len(turns) + 1)]
    head = bool(turns) and turns[0][0] == "system"
    out, at = [], int(head)
    if head and len(turns) == 1:
        return [((), (0,))]
    while at < len(turns):
        limit = (start[at] // (segment * budget) + 1) * segment * budget
        room = budget - (size[0] if head else 0)
        context: list[int] = []
        while (i := at - 1 - len(context)) >= int(head) and sum(size[j] for j in context) + size[i] <= history and sum(size[j] for j in context) + size[i] + size[at] <= room:
            context.append(i)
        used, new = sum(size[j] for j in context) + size[at], [at]
        while new[-1] + 1 < len(turns) and start[new[-1] + 1] < limit and used + size[new[-1] + 1] <= room:
            new.append(new[-1] + 1)
            used += size[new[-1]]
        first = [0] if head else []
        out.append((tuple(first * bool(out)) + tuple(reversed(context)), tuple(first * (not out)) + tuple(new)))
        at = new[-1] + 1
    return out


@pytest.mark.parametrize("budget,history,segment", [(120, 30, 2), (64, 60, 3), (400, 0, 32)])
def test_chat_windows_equal_brute_force(spark, budget, history, segment):
    rows = conversations()
    automaton = wordpiece.LongestMatch(vocabulary(VOCABULARY)[0])
    count = lambda role, text: chat.MARKS + sum(automaton.count(b" " + w) for w in f"{chat.escape_role(role)} {chat.escape(text)}".encode().split())
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = defaultdict(list)
    for r in chat.windows(df, VOCABULARY, budget, history, segment).orderBy("conv_id", "segment", "window").collect():
        got[r["conv_id"]].append(r)
    for conv, turns in grouped(rows).items():
        want = brute_windows(turns, count, budget, history, segment)
        assert [(r["n_context"], r["n_turns"]) for r in got[conv]] == [(len(c), len(n)) for c, n in want], conv
        for r, (context, new) in zip(got[conv], want, strict=True):
            assert chat.read_turns(r["text"]) == [turns[i] for i in context + new]
            assert [chat.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] == [turns[i][1] for i in new if turns[i][0] == "assistant"]
            assert r["tokens"] == sum(count(*turns[i]) for i in context + new)
            assert r["tokens"] <= budget or len(new) - (new[0] == 0 and turns[0][0] == "system") <= 1


def test_chat_of_one_long_conversation_over_many_tasks(spark):
    """A conversation of most rows goes on over the tasks of the sort and over segments."""
    rows = spark.range(0, 30_000, 1, 6).selectExpr("if(id % 10 = 0, id, 5) as conv_id", "id as turn", "if(id = 1, 'system', if(id % 2 = 0, 'user', 'assistant')) as role", "concat('turn ', id) as text")
    out = materialise(chat.windows(rows, VOCABULARY, budget=100, history=30, segment=4))
    hot = [chat.read_turns(r["text"])[r["n_context"] :] for r in out.where("conv_id = 5").orderBy("segment", "window").collect()]
    assert [t for w in hot for _, t in w] == [f"turn {i}" for i in range(30_000) if i % 10]
    assert out.where("conv_id = 5 and not startswith(text, '<|im_start|>system\nturn 1<|im_end|>')").count() == 0
    assert out.where("tokens > 100").count() == 0
    assert out.where("conv_id = 5").agg(F.max("segment")).first()[0] > 500
    got = chat.read_back(out).where("conv_id = 5").first()
    targets = "".join(f"turn {i}" for i in range(3, 30_000, 2))
    assert (got["n_turns"], got["loss_sha256"]) == (27_000, hashlib.sha256(targets.encode()).hexdigest())
    assert chat.read_back(materialise(chat.windows(rows.limit(0), VOCABULARY))).count() == 0


# ---- operator 13


def brute_audit(rows, least=10, top=10):
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    words = [(lang or "", source or "", TERM.findall(lower(t))) for lang, source, t in rows]
    out = []
    for lang in {w[0] for w in words}:
        docs = Counter(t for x, _, w in words if x == lang for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: Counter() for x, s, _ in words if x == lang}
        for x, s, w in words:
            if x == lang:
                counts[s].update(t for t in w if docs[t] >= least)
        v, whole = len(kept), sum(counts.values(), Counter())
        p = {s: {t: share(c[t], sum(c.values()), v) for t in kept} for s, c in counts.items()}
        q = {t: share(whole[t], sum(whole.values()), v) for t in kept}
        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audit_rows():
    r = random.Random(4)
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", None, "é"]), t) for t in texts(400, 5)]
    rows += [("en", f"s{i}", "kata mero zuta") for i in range(30)]
    return [*rows, *rows[:7], ("fr", "a", "alone here"), ("fr", "b", None), ("en", "empty", ""), ("de", "digits", "12 345"), ("en", "long", "Kata " * 50_000)]


@pytest.mark.parametrize("width,band", [(2048, 128), (4, 8), (16, 3)])
def test_audit_equals_brute_force(spark, width, band):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("x") for c in ("g", "p", "term", "band", "n", "v")}).repartition(5)
    got = divergence.audit(docs, width=width, band=band)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_quadtree_walk_equals_dense():
    r = np.random.default_rng(7)
    for rows, cols, n in ((5, 9, 3), (40, 100, 60), (128, 30, 900), (17, 256, 1)):
        trees, dense = [], []
        for _ in range(2):
            cell = r.choice(rows * cols, min(n, rows * cols), replace=False)
            values, rest = r.integers(5, 10**9, len(cell)), r.integers(1, 10**6, rows)
            full = np.repeat(rest[:, None], cols, axis=1)
            full[cell // cols, cell % cols] = values
            dense.append((full, np.isin(np.arange(rows * cols), cell).reshape(rows, cols)))
            trees.append(divergence.QuadTree(cell // cols, cell % cols, values, rest, 256))
        for (a, x), (b, y), one, two in ((dense[0], dense[1], trees[0], trees[1]), (dense[0], dense[0], trees[0], trees[0])):
            sums, touched = divergence.walk(one, two, cols)
            for i in range(rows):
                for j in range(i + 1 if one is two else 0, rows):
                    whole = sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(a[i], b[j], strict=True))
                    f0 = min((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q, u, w in zip(a[i], b[j], x[i], y[j], strict=True) if not u and not w)
                    assert sums[i, j] + (cols - touched[i, j]) * f0 == whole
            assert touched.max() <= cols
