"""Operators 2, 4, 6, 7, 8, 10 against brute force, with nulls, repeats, long texts, empty tables, odd columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lakekeel.llm import bpe, decontaminate, licences, media, urlfilter, wordpiece
from lakekeel.llm.common import folded_words

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello world", "Hello world", "a\x00b \x1c\u00a0\u2003c", "Ünïcödé ñ 漢字 😀 don't we'll", "x" * 3000, "\n\n  \t mixed   spaces \n", "1234 + 5678 = 6912!!!",
    "word " * 2000, "<|endoftext|>", "é" * 700,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, n_tokens int").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_library_and_round_trips(docs):
    got = by_id(bpe.encode_decode(docs, VOCABULARY, P.PATTERN))
    own = bpe.encoder(VOCABULARY, P.PATTERN)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids, r = own.encode_ordinary(t or ""), got[i if i != 3 else None]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_ids_and_empty(spark, docs):
    fixed = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").coalesce(1)
    for r in bpe.encode_decode(fixed, VOCABULARY, P.PATTERN, digests=False).collect():
        assert r["ids"] == bpe.encoder(VOCABULARY, P.PATTERN).encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert bytes(r["decoded"]) == (TEXTS[r["doc_id"]] or "").encode()
    assert bpe.encode_decode(fixed.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_bpe_repeated_rows_over_partitions(spark):
    long = "word of many " * 20
    one = spark.createDataFrame([(1, "x"), (None, "null id"), (2, long)], "doc_id bigint, text string").coalesce(1)
    turned = [spark.createDataFrame([(3, t)], "doc_id bigint, text string").coalesce(1) for t in (" a a b b", " a b b a")]
    df = one.unionByName(one).unionByName(one).unionByName(turned[0]).unionByName(turned[1])
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in bpe.encode_decode(df, VOCABULARY, P.PATTERN, digests=False).collect())
    assert got == sorted([(1, "x"), (0, "null id"), (2, long)] * 3 + [(3, " a a b b"), (3, " a b b a")])
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id bigint, text string").repartition(2)
    assert bpe.encode_decode(twice, VOCABULARY, P.PATTERN).count() == 2
    many = spark.range(0, 20000, 1, 7).selectExpr("if(id % 2 = 0, 1, null) as doc_id", "if(id % 2 = 0, 'hello world', '') as text")
    assert bpe.encode_decode(many, VOCABULARY, P.PATTERN).count() == 20000


def test_bpe_of_rows_that_change_between_readings(spark):
    df = spark.range(0, 300, 1, 3).selectExpr("id as doc_id", "cast(rand() as string) || ' ' || id as text")
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.encode_decode(df, VOCABULARY, P.PATTERN, digests=False).collect()}
    assert len(got) == 300 and all(t.endswith(f" {i}") for i, t in got.items())


def test_splitter_pieces_encode_alone():
    own, split = bpe.encoder(VOCABULARY, P.PATTERN), bpe.splitter(P.PATTERN)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "Z", " ", "  ", "\n", "\t", "9", "!", "'s", "é", "漢", "\u00a0", "\x1d", "\u2028", "😀"]) for _ in range(rng.randint(0, 30)))
        assert "".join(split.findall(t)) == t
        assert [i for w in split.findall(t) for i in own.encode_ordinary(w)] == own.encode_ordinary(t)


def test_greedy_counts_equal_brute_force():
    def brute(word, vocabulary):
        at = n = 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
            if not size:
                return 1
            at, n = at + size, n + 1
        return n

    rng = random.Random(1)
    for trial in range(300):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        own = wordpiece.LongestMatch(vocabulary)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert own.count(word) == brute(word, vocabulary), (word, vocabulary)


def test_token_counts(docs):
    got = by_id(wordpiece.token_counts(docs, VOCABULARY))
    vocabulary = bpe.vocabulary(VOCABULARY)[0]
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0
    assert got[4]["n_words"] == 2 and got[10]["n_words"] == 2000
    word, n, at = b" " + b"x" * 3000, 0, 0
    while at < len(word):
        at += next(k for k in range(min(64, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    longest = max(map(len, vocabulary))
    if longest <= 64:
        assert got[7]["n_tokens"] == n


def test_media_round_trip(docs):
    got = by_id(media.media_columns(docs, with_tensor=True))
    for i, t in enumerate(TEXTS):
        raw, r = (t or "").encode(), got[i if i != 3 else None]
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(full) and bytes(r["payload"]) == full
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert len(r["tensor"]) == r["height"] * r["width"] * 3
    assert got[3 if False else None]["feature"] == got[4]["feature"] and got[3 if False else None]["media_sha256"] == got[4]["media_sha256"]


def test_all_byte_values_and_both_readers_agree():
    payload = media.padded(bytes(range(256)) * 5 + bytes(np.random.default_rng(0).integers(0, 256, 3000, dtype=np.uint8)))
    data = media.encode_payload(payload)
    fast, slow = media.Jpeg(data), media.Jpeg(data, fast=False)
    assert fast.payload() == slow.payload() == payload
    assert all((fast.coefficients[c] == slow.coefficients[c]).all() for c in (1, 2, 3))
    assert (fast.rgb() == slow.rgb()).all()


class Writer:
    """A small progressive encoder with a complete Huffman table, for the reader's tests."""

    SYMBOLS = [r << 4 | s for r in range(16) for s in range(11)]

    def __init__(self):
        self.codes = {s: (i, 8) for i, s in enumerate(self.SYMBOLS)}
        self.bits = ""

    def table(self, kind):
        return media._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [len(self.SYMBOLS)] + [0] * 8) + bytes(self.SYMBOLS))

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def symbol(self, s):
        self.put(*self.codes[s])

    def signed(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def take(self):
        bits, self.bits = self.bits + "1" * (-len(self.bits) % 8), ""
        return media._stuffed(int(bits or "0", 2).to_bytes(len(bits) // 8, "big"))


def encode_general(blocks, width, height):
    """Blocks {component: (rows, cols, 64)} in 4:2:0, DC with Al=1 and a refinement, AC in two bands with Al=1 and a refinement."""
    w = Writer()
    out = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes([3] * 64))]
    import struct

    out.append(media._segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [w.table(0), w.table(1)]
    mcu_rows, mcu_cols = blocks[2].shape[:2]
    dc_order = [(c, r * v + y, k * v + x) for r in range(mcu_rows) for k in range(mcu_cols) for c, v in ((1, 2), (2, 1), (3, 1)) for y in range(v) for x in range(v)]
    previous = {1: 0, 2: 0, 3: 0}
    for c, r, k in dc_order:
        v = int(blocks[c][r, k, 0]) >> 1
        d, previous[c] = v - previous[c], v
        w.symbol(abs(d).bit_length())
        if d:
            w.signed(d, abs(d).bit_length())
    out.append(media._scan([1, 2, 3], 0, 0, 0, 1, w.take()))
    for c, r, k in dc_order:
        w.put(int(blocks[c][r, k, 0]) & 1, 1)
    out.append(media._scan([1, 2, 3], 0, 0, 1, 0, w.take()))
    for c, v in ((1, 1), (2, 2), (3, 2)):  # scans of one component leave out blocks beyond the picture
        flat = blocks[c][: -(-(-(-height // v)) // 8), : -(-(-(-width // v)) // 8)].reshape(-1, 64)
        for ss, se in ((1, 5), (6, 63)):
            pending = 0

            def flush():
                nonlocal pending
                if pending:
                    n = pending.bit_length() - 1
                    w.symbol(n << 4)
                    w.put(pending - (1 << n), n)
                    pending = 0

            for b in flat:
                run = 0
                for k in range(ss, se + 1):
                    v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
                    if not v:
                        run += 1
                        continue
                    flush()
                    while run > 15:
                        w.symbol(0xF0)
                        run -= 16
                    size = abs(v).bit_length()
                    w.symbol(run << 4 | size)
                    w.signed(v, size)
                    run = 0
                if run:
                    pending += 1
            flush()
            out.append(media._scan([c], ss, se, 0, 1, w.take()))
        for b in flat:  # refinement, an end of block each
            run, held = 0, ""
            news = [k for k in range(1, 64) if abs(int(b[k])) == 1]
            last = news[-1] if news else 0
            for k in range(1, 64):
                old = abs(int(b[k])) > 1
                if k > last:
                    break
                if old:
                    held += str(abs(int(b[k])) & 1)
                elif abs(int(b[k])) == 1:
                    w.symbol(run << 4 | 1)
                    w.put(1 if b[k] > 0 else 0, 1)
                    w.bits += held
                    run, held = 0, ""
                else:
                    run += 1
                    if run == 16:
                        w.symbol(0xF0)
                        w.bits += held
                        run, held = 0, ""
            if last < 63:
                w.symbol(0)
                w.bits += held + "".join(str(abs(int(b[k])) & 1) for k in range(last + 1, 64) if abs(int(b[k])) > 1)
        out.append(media._scan([c], 1, 63, 1, 0, w.take()))
    return b"".join(out) + b"\xff\xd9"


def test_general_progressive_pictures():
    rng = np.random.default_rng(7)
    for width, height in ((16, 16), (40, 23), (9, 33), (1, 1)):
        rows, cols = -(-height // 16), -(-width // 16)
        blocks = {}
        for c, v in ((1, 2), (2, 1), (3, 1)):
            b = np.where(rng.random((rows * v, cols * v, 64)) < 0.15, rng.integers(-60, 61, (rows * v, cols * v, 64)), 0)
            b[..., 0] = rng.integers(-200, 200, b.shape[:2])
            blocks[c] = b
        blocks[1][-(-height // 8) :, :, 1:] = 0
        blocks[1][:, -(-width // 8) :, 1:] = 0
        got = media.Jpeg(encode_general(blocks, width, height))
        for c in (1, 2, 3):
            assert (got.coefficients[c] == blocks[c]).all()
        rgb = got.rgb()
        assert rgb.shape == (height, width, 3)
        y = np.zeros((16 * rows, 16 * cols))
        basis = media._B
        for r in range(2 * rows):
            for k in range(2 * cols):
                f = np.zeros(64)
                f[media.ZIGZAG] = blocks[1][r, k] * 3
                y[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] = np.clip(np.round(basis.T @ f.reshape(8, 8) @ basis + 128), 0, 255)
        assert np.abs(got.plane(1) - y).max() <= 1


def brute_contamination(text, items, window=13):
    words = folded_words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = folded_words((t or "").encode())
        if not w:
            continue
        n = min(window, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_random(spark):
    rng = random.Random(5)
    alphabet = ["a", "B", "c", "dé", "e7"]
    make = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 6, 12, 13, 14, 30]))) for i in range(1, 12)] + [(50, None), (51, "..."), (52, "a b")]
    texts = [None, "", "zz " * 50] + [make(rng.randint(1, 60)) for _ in range(40)]
    texts += [f"{make(10)} {t} {make(200)}" for _, t in items if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_contamination(t, items), (i, t)


def test_clean_cuts_spans_and_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{filler}, {passage}; end", "x"), (2, passage, "y"), (3, None, None), (4, filler, "z")], "doc_id bigint, text string, spans string")
    got = by_id(decontaminate.clean(docs, spark.createDataFrame([(9, passage.upper())], "item_id bigint, text string")))
    assert set(got) == {1, 3, 4} and got[1]["text"] == f"{filler}, ; end" and got[4]["text"] == filler and got[1]["spans"] == "x"
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(docs, empty).count() == 4
    assert decontaminate.contamination(docs.limit(0), empty).count() == 0


def test_shards_merge(monkeypatch, spark):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40)
    items = [(i, " ".join(f"q{i}{k}" for k in range(14))) for i in range(6)]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items)), (2, items[3][1])], "doc_id bigint, text string")
    got = by_id(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert (got[1]["n_hit"], got[1]["n_items"], got[2]["n_items"]) == (84, 6, 1)
    texts = [*(f"{t} tail {items[0][1]} end" for _, t in items), None, "", " ".join(f"f{i}" for i in range(900)) + items[2][1]]
    rows = [(i // 2 if i != 4 else None, t, "k") for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, hit_key string")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = sorted((i, *brute_contamination(t, items)) for i, t, _ in rows if i is not None)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got if r["doc_id"] is not None) == want
    kept = decontaminate.clean(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns and kept.count() == 6


def test_licences(spark):
    texts = [
        None, "", "Released under the MIT License.", "under the mit license under THE MIT-License", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "mit mit license mit", "licensed under terms of the gnu general public license version 3", "apache license version",
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    got = by_id(licences.scan_licences(docs))
    for i, t in enumerate(texts):
        words = folded_words((t or "").encode())
        places, labels = [], set()
        for label, phrase in licences.BASE:
            p = phrase.encode().split()
            own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert got[6]["labels"] == "gpl-3" and got[6]["score"] == 1.0 and got[0]["labels"] == "" and got[7]["labels"] == ""


def test_every_notice_with_its_key_phrase_is_found():
    rng = random.Random(7)
    vocabulary = sorted({w for t in [*licences.BASE, *licences.NOTICES] for w in t[1].encode().split()})
    for _ in range(20):
        idf = {w: rng.random() for w in vocabulary}
        index = licences.LicenceIndex(idf)
        for label, notice, key in licences.NOTICES:
            words, k = notice.encode().split(), key.encode().split()
            a = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            free = [i for i in range(len(words)) if not a <= i < a + len(k)]
            rarest = sorted(free, key=lambda i: -idf[words[i]])
            changed = rarest[: int((1 - licences.NOTICE_SHARE) * len(words))] if len(words) < 30 else rng.sample(free, len(words) // 10)
            text = [b"other" if i in changed else w for i, w in enumerate(words)]
            _, _, labels, score = index.scan([b"start", *text, b"end"])
            assert label in labels and score >= (len(words) - len(changed)) / len(words) - (0.05 if len(words) >= 30 else 0)
    isc = next(n for label, n, _ in licences.NOTICES if label == "isc")
    idf = {w: 1.0 + (w in (b"copy", b"modify", b"distribute")) for w in vocabulary}
    assert "isc" in licences.LicenceIndex(idf).scan(isc.replace("copy modify and or distribute", "x y and or z").encode().split())[2]


def test_notices_with_gaps(spark):
    index = licences.LicenceIndex({w: 1.0 for t in [*licences.BASE, *licences.NOTICES] for w in t[1].encode().split()})
    mit = next(n for label, n, _ in licences.NOTICES if label == "mit" and len(n.split()) > 100).encode().split()
    for text in (mit[:3] + [b"x"] * 2 + mit[3:], mit[:90] + mit[93:], mit[:60] + [b"new", b"words"] + mit[62:], [b"z"] * 500 + mit + [b"z"] * 500):
        _, _, labels, score = index.scan(text)
        assert labels == {"mit"} and score > 0.95
    assert index.scan(mit[30:60])[2] == set()
    texts = [(1, "a " * 600_000 + "Released under the MIT license"), (1, "a " * 600_000 + "Released under the MIT license"), (2, None)]
    got = licences.scan_licences(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in got) == [(1, 600_005, 1, "mit")] * 2 + [(2, 0, 0, "")]
    assert licences.scan_licences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_globs_equal_brute_force():
    import re

    rng = random.Random(2)
    globs = ["*.org/**", "**a*b**", "", "**", "*", "a/b", "*.x/*.y"] + ["".join(rng.choice(["a", "b", ".", "/", "*", "**"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["", ".a.org/", "/" * 70] + ["".join(rng.choice("ab./") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    found = urlfilter.GlobAutomaton(globs).matches([t.encode() for t in texts])
    for k, glob in enumerate(globs):
        parts = re.split(r"(\*+)", glob)
        pattern = "".join(("(?s:.*)" if "**" in x else "[^/]*") if x.startswith("*") else re.escape(x) for x in parts)
        if re.search(r"\*{3}", glob):
            continue
        assert [bool(re.fullmatch(pattern, t)) for t in texts] == found[:, k].tolist(), glob


def test_url_verdicts(spark):
    urls = [
        None, "no scheme", "http://org/x", "HTTP://A.ORG/", "http://example.org/es/1", "http://x.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org?x", "http://a.com/fr/x",
        "http://a.com/de/?q", "http://a.com/en/", "http://cheap-pills.net/a", "x://h#f/es/", "http://example.org:80/es/",
    ]
    got = by_id(urlfilter.url_verdicts(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")), "page_id")
    want = [
        (None, "allow"), (None, "allow"), ("org/", "allow"), ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), (None, "allow"), ("com/fr/", "allow"),
        ("com/de/", "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"),
    ]
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == want
    assert (got[3]["host"], got[3]["path"]) == ("a.org", "/") and (got[0]["host"], got[0]["path"]) == ("", "") and (got[13]["host"], got[13]["path"]) == ("h", "")
