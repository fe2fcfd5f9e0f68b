"""Operator 12: chat formatting in budgeted windows.

Method. A conversation's turns are escaped, counted in tokens (pieces by the automaton of `wordpiece`, and `MARKS` for the template) and summed up in order. From these
prefix sums come windows of whole turns: each takes as many new turns as the budget has room for beside the conversation's system turn and at most `HISTORY`
tokens of the turns right before, which are repeated. Loss spans mark the texts of new assistant turns alone, so what is repeated is context and
every target counts once. A turn that no budget holds has a window of its own, whole, beside the system turn.

Template. `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In texts and roles, `<` followed by backslashes and `|` gets one backslash more, so that no control
string occurs inside; reading takes it away again. In roles, backslashes and line feeds are written as `\\\\` and `\\n`.

Scale. Rows are sorted once by conversation and turn over all tasks, and each task hands on what its first and last conversation sum to (at most two rows a
task count). Conversations are cut by their prefix sums into segments of SEGMENT tokens, in which windows are chosen independently, with the turns before a segment
that its first windows may repeat; so no task takes a whole conversation. Only digests over a whole conversation stream its windows through one task, since SHA-256 has
no other way; nothing is held there.

Defined cases: null text and role are empty; null turns come first, equal turns by role and text; a null id is a conversation of its own; repeated
rows are turns like others; only a first turn is retained as the system turn; texts of any length stay whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import arrow_map, materialise
from .wordpiece import LongestMatch

BUDGET, HISTORY = 1024, 256
#: Tokens of a segment, as a multiple of the budget.
SEGMENT = 32
#: Tokens of a turn's marks.
MARKS = 4
START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Segments that one row is copied to at once.
_COPIES = 4096
#: Segments that a task takes up at once.
_ROWS = 64


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def spans(starts: list[int], ends: list[int], first: int, system: int, budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[int, int, int]]:
    """Windows (first repeated, first new, end) over turns with the prefix sums `starts` and `ends`, as indexes into them; turns before `first` are
    only repeated. system: tokens of the system turn that every window but its own retains."""
    at = first
    while at < len(starts):
        least = bisect_left(starts, starts[at] - history, 0, at)
        least = max(least, min(at, bisect_left(starts, ends[at] + system - budget, 0, at)))  # the new turn first
        end = at + 1
        while end < len(starts) and system + ends[end] - starts[least] <= budget:
            end += 1
        yield least, at, end
        at = end


def scanned(turns: DataFrame, path: str) -> DataFrame:
    """Turns (conv_id, turn, role, text) in order, escaped, with tokens and their sums so far (upto, at) within the task's part of the conversation."""
    shared = turns.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary(path)[0]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter, part = shared.value, TaskContext.get().partitionId()
        now, upto, at = object(), 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict = {"conv_id": batch.column(0), "role": [], "text": [], "tokens": [], "part": [part] * len(ids), "upto": [], "at": []}
            for conv, role, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != now:
                    now, upto, at = conv, 0, 0
                role, text = escape_role(role or ""), escape(text or "")
                tokens = MARKS + sum(map(counter.remembered, f"{role} {text}".encode().split()))
                upto += tokens
                for name, value in (("role", role), ("text", text), ("tokens", tokens), ("upto", upto), ("at", at)):
                    out[name].append(value)
                at += 1
            yield out

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.withColumn("row", F.monotonically_increasing_id()).orderBy("conv_id", "turn", "role", "text", "row")
    return arrow_map(ordered.select("conv_id", "role", "text"), step, f"conv_id {kind}, role string, text string, tokens bigint, part int, upto bigint, at bigint")


def numbered(turns: DataFrame, path: str) -> DataFrame:
    """Turns with `number` in their conversation, from 0, and the prefix sums `start` and `end`."""
    table = materialise(scanned(turns, path))
    sums = table.groupBy("part", "conv_id").agg(F.max("upto").alias("tokens"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.sum("tokens").over(before).alias("more"), F.sum("turns").over(before).alias("turns"))
    carry = carry.where("more is not null")  # at most one row for each task of the sort: where a conversation goes on
    joined = table.join(F.broadcast(carry), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").fillna(0, ["more", "turns"])
    end = F.col("upto") + F.col("more")
    return joined.select("conv_id", "role", "text", "tokens", (F.col("at") + F.col("turns")).alias("number"), (end - F.col("tokens")).alias("start"), end.alias("end"))


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv_id, segment, window, n_context: turns in front that are repeated, n_turns: new ones, tokens, text, loss: code point spans (start, end)).
    turns (conv_id, turn, role, text) with any further columns; path: the vocabulary that counts tokens."""
    size = segment * budget
    table = numbered(turns.select("conv_id", "turn", "role", "text"), path)
    own = table.withColumns({"segment": F.expr(f"start div {size}"), "kind": F.lit(2)})
    halo = own.where(F.col("start") >= (F.col("segment") + 1) * size - history).withColumns({"segment": F.col("segment") + 1, "kind": F.lit(1)})
    halo = halo.where(~((F.col("number") == 0) & (F.col("role") == "system")))
    last = own.groupBy("conv_id").agg(F.max("segment").alias("last")).where("last > 0").withColumnRenamed("conv_id", "c")
    system = own.where("number = 0 and role = 'system'").join(last, F.col("conv_id").eqNullSafe(F.col("c")))
    copies = system.withColumn("block", F.explode(F.expr(f"sequence(0L, last div {_COPIES})")))
    copies = copies.withColumn("segment", F.explode(F.expr(f"sequence(greatest(1L, block * {_COPIES}), least(last, (block + 1) * {_COPIES} - 1))")))
    copies = copies.withColumn("kind", F.lit(0)).select(*own.columns)
    turn = F.struct("number", "kind", "role", "text", "tokens", "start", "end")
    cut = own.unionByName(halo).unionByName(copies).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("conv_id", "segment", "window", "n_context", "n_turns", "tokens", "text", "loss")
        for part in (batch.slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS)):
            out: dict = {n: [] for n in names}
            for conv, number, rows in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                head = rows[0] if rows[0]["number"] == 0 and rows[0]["role"] == "system" else None
                rest = rows[1:] if head else rows
                first = sum(r["kind"] == 1 for r in rest)
                tokens = head["tokens"] if head else 0
                new = bool(head) and head["kind"] == 2  # the system turn is here for the first time
                found = list(spans([r["start"] for r in rest], [r["end"] for r in rest], first, tokens, budget, history))
                if new and not found:
                    found = [(0, 0, 0)]
                for window, (least, at, end) in enumerate(found):
                    mine = ([head] if head else []) + rest[least:end]
                    context = len(mine) - (end - at) - (new and window == 0)
                    text, loss, length = [], [], 0
                    for i, r in enumerate(mine):
                        before = len(START) + len(r["role"]) + 1
                        if i >= context and r["role"] == TARGET:
                            loss.append({"start": length + before, "end": length + before + len(r["text"])})
                        length += before + len(r["text"]) + len(END)
                        text += [START, r["role"], "\n", r["text"], END]
                    values = (conv, number, window, context, len(mine) - context, sum(r["tokens"] for r in mine), "".join(text), loss)
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
            yield out

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, segment bigint, window bigint, n_context bigint, n_turns bigint, tokens bigint, text string, loss array<struct<start:bigint,end:bigint>>"
    return arrow_map(cut, step, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window; it must be turns from end to end."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        found.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests by conversation of written windows: new turns in order, and the text under the loss spans."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {n: batch.column(i) for i, n in enumerate(("conv_id", "segment", "window"))} | {"n_turns": [], "turns": [], "loss": [], "chars": []}
            for context, text, loss in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                new = read_turns(text)[context:]
                out["n_turns"].append(len(new))
                out["turns"].append("".join(f"{role}\n{said}\n" for role, said in new))
                out["loss"].append("".join(unescape(text[s["start"] : s["end"]]) for s in loss))
                out["chars"].append(len(text))
            yield out

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        now, state = object(), None

        def end() -> list:
            conv, n, turns, loss_chars, loss, chars = state
            return [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            for conv, n, turns, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if conv != now:
                    if state:
                        done.append(end())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(turns.encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            if done:
                yield dict(zip(names, map(list, zip(*done, strict=True)), strict=True))
        if state:
            yield dict(zip(names, ([x] for x in end()), strict=True))

    kind = formatted.schema["conv_id"].dataType.simpleString()
    parsed = arrow_map(formatted.select("conv_id", "segment", "window", "n_context", "text", "loss"), parse, f"conv_id {kind}, segment bigint, window bigint, n_turns bigint, turns string, loss string, chars bigint")
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return arrow_map(ordered, digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, TARGET, said)], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(materialise(windows(turns, P.path("byte_bpe_multi_50k.tiktoken"))))
