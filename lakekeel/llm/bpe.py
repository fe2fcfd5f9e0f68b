"""Operator 6: byte-level BPE encoding and decoding through a global distinct-word shuffle.

Method. A pre-tokeniser cuts each text into words. Texts are taken in blocks; a block keeps, for each
text, the positions of its words as numbers into the block's list of distinct words. These lists are
shuffled by a hash of the word, so every distinct word of the corpus meets in one group and is encoded
once there; the ids go back to the blocks, and each text is put together by position. Words and positions
come from two readings, so that positions are shuffled only once; an input that is not known to be read alike twice is
written to the shared folder first. Blocks carry the hash of their contents. Blocks of one name (repeated
rows) have the same distinct words; each of them is put together by its own positions. Decoding joins the
ids with the table of token bytes. This table is broadcast; the vocabulary file bounds its size.

Defined cases: null text counts as empty (no tokens); any text length; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, ranges

#: Text characters per block of documents.
BLOCK_CHARS = 8 << 20
#: Bounds on the number of groups into which a block's distinct words are dealt by hash.
LEAST_GROUPS, MOST_GROUPS = 16, 1 << 14


@functools.lru_cache(maxsize=2)
def token_table(raw: bytes) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """Ranks of token bytes, and the bytes of each rank, from the contents of a .tiktoken file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return ranks, {rank: token for token, rank in ranks.items()}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    return token_table(Path(path).read_bytes())


@functools.lru_cache(maxsize=2)
def encoder_of(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_table(raw)[0], special_tokens={})


def encoder(path: str, pattern: str):
    return encoder_of(Path(path).read_bytes(), pattern)


@functools.lru_cache(maxsize=2)
def splitter(pattern: str):
    """The pre-tokeniser. `\\s` is spelled out as White_Space, since Python's also takes U+001C to U+001F."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed value: count, lengths, contents."""
    head = np.array([len(parts), *map(len, parts)], np.uint32).tobytes()
    return zstandard.compress(head + b"".join(parts), 3)


def unpack(value: bytes) -> list[bytes]:
    raw = zstandard.decompress(value)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)]) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def group_of(word: bytes, groups: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % groups


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def blocks(docs: DataFrame, pattern: str, groups: int, kind: int) -> DataFrame:
    """Rows (block, grp, kind, payload) of one kind. 0: a block's documents as word numbers, with the group of each
    distinct word. 1: the distinct words of a block in one group. Blocks are named by their contents, so that the
    two kinds, which are computed apart, agree on them.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words_of = splitter(pattern).findall
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for a, b in ranges([len(t) for t in texts], BLOCK_CHARS):
                # words by first appearance: frequent ones mostly come early, so that their numbers compress well
                index, rows, sizes = Numbers(), [], []
                for text in texts[a:b]:
                    found = words_of(text)
                    sizes.append(len(found))
                    if kind == 0:
                        rows.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                    else:
                        index |= dict.fromkeys(found)
                words = [w.encode() for w in index]
                group = [group_of(w, groups) for w in words]
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([ids.slice(a, b - a)], ["i"])
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                head = sink.getvalue().to_pybytes()
                counts = np.array(sizes, np.uint32).tobytes()
                digest = xxhash.xxh3_128(head + counts)
                for word in words:
                    digest.update(word)
                block = digest.hexdigest()
                if kind == 0:
                    lanes = np.concatenate(rows).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    yield {"block": [block], "grp": [-1], "kind": [0], "payload": [pack([head, counts, lanes, np.array(group, np.uint16).tobytes()])]}
                else:
                    dealt: dict[int, list[bytes]] = {}
                    for g, word in zip(group, words):
                        dealt.setdefault(g, []).append(word)
                    n = len(dealt)
                    yield {"block": [block] * n, "grp": [*dealt], "kind": [1] * n, "payload": [*map(pack, dealt.values())]}

    return arrow_map(docs, step, "block string, grp int, kind int, payload binary")


def encoded_words(words: DataFrame, vocab, pattern: str, width: type) -> DataFrame:
    """words come sorted by group, and each partition holds whole groups; every distinct word of a group is encoded once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder_of(vocab.value, pattern).encode_ordinary
        current, known = None, {}
        for batch in batches:
            for block, grp, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if grp != current:
                    current, known = grp, {}
                ids = []
                for word in unpack(payload):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encode(word.decode()), width).tobytes()
                    ids.append(got)
                yield {"block": [block], "grp": [grp], "kind": [1], "payload": [pack(ids)]}

    return arrow_map(words, step, "block string, grp int, kind int, payload binary")


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True, stable: bool = False) -> DataFrame:
    """Per document the ids and the decoded bytes, or (digests) their counts and hashes. stable: docs is a table, which gives the
    same rows in the same order whenever it is read; other inputs are written first.

    Columns: id_col, n_tokens, then ids (array<int>) and decoded (binary), or ids_sha256 and decoded_sha256.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, text_col)
    if not stable:
        own = materialise(own)
    raw = Path(path).read_bytes()
    vocab = docs.sparkSession.sparkContext.broadcast(raw)
    width = np.uint16 if len(token_table(raw)[0]) <= 65536 else np.uint32
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(max(n, LEAST_GROUPS), MOST_GROUPS)
    words = blocks(own, pattern, groups, 1).select("block", "grp", "payload").repartition(n, "grp").sortWithinPartitions("grp")
    coded = encoded_words(words, vocab, pattern, width)
    both = blocks(own, pattern, groups, 0).unionByName(coded).repartition(n, "block").sortWithinPartitions("block", F.desc("kind"))
    out_cols = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"

    def finish(head: list[bytes], coded: dict[int, list[bytes]]) -> dict:
        ids_raw, counts_raw, lanes_raw, group_raw = head
        group = np.frombuffer(group_raw, np.uint16)
        table: list[bytes] = [b""] * len(group)
        by_group = np.argsort(group, kind="stable")
        found = [w for g in sorted(coded) for w in coded[g]]
        if len(found) != len(table):
            raise RuntimeError("the input changed between its two readings; materialise it first")
        for i, w in zip(by_group.tolist(), found):
            table[i] = w
        ids = pa.ipc.open_stream(ids_raw).read_all().column(0)
        counts = np.frombuffer(counts_raw, np.uint32)
        numbers = np.ascontiguousarray(np.frombuffer(lanes_raw, np.uint8).reshape(4, -1).T).view("<u4").ravel() if lanes_raw else np.zeros(0, np.uint32)
        token_bytes = token_table(vocab.value)[1]
        each = [np.frombuffer(t, width).tolist() for t in table]
        lengths = np.array([len(e) for e in each], np.int64) if each else np.zeros(0, np.int64)
        plain = [b"".join(map(token_bytes.__getitem__, e)) for e in each]
        ends = np.cumsum(counts, dtype=np.int64)
        cols: dict = {id_col: ids.combine_chunks(), "n_tokens": []}
        first, second = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
        cols[first], cols[second] = [], []
        if digests:
            text_ids = [",".join(map(str, e)) for e in each]
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = numbers[a:b]
            seq = own.tolist()
            cols["n_tokens"].append(int(lengths[own].sum()))
            decoded = b"".join(map(plain.__getitem__, seq))
            if digests:
                cols[first].append(hashlib.sha256(",".join(map(text_ids.__getitem__, seq)).encode()).hexdigest())
                cols[second].append(hashlib.sha256(decoded).hexdigest())
            else:
                cols[first].append([i for s in seq for i in each[s]])
                cols[second].append(decoded)
        return cols

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, heads, coded, copies = None, 0, {}, Counter()

        def agree() -> None:
            """Each reading gave the block equally often."""
            if current is not None and (not heads or any(k != heads for k in copies.values())):
                raise RuntimeError("the input changed between its two readings; materialise it first")

        for batch in batches:
            for block, grp, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != current:
                    agree()
                    current, heads, coded, copies = block, 0, {}, Counter()
                if kind == 0:  # after the block's words
                    heads += 1
                    yield finish(unpack(payload), coded)
                else:
                    copies[grp] += 1
                    if grp not in coded:
                        coded[grp] = unpack(payload)
        agree()

    return arrow_map(both, step, f"{id_col} {id_type}, n_tokens bigint, {out_cols}")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, stable=True)
