"""sipHash64 and seahash as column expressions.

A hash is an unsigned number held in a bigint; `ordered`, `umod` and `udecimal` read it as one.
Bytes are folded in 8-byte little-endian blocks, those of an Arrow batch side by side in unsigned 64-bit arithmetic, so any length works and a row costs a few
array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

_LOW = 0xFFFFFFFF

# The initial state of sipHash, the seeds and the multiplier of seahash.
SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
SEA = (0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381)
MULTIPLIER = 0x6EED0E9DA4D94A4F


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def lit64(n: int) -> Column:
    return F.lit(signed(n)).cast("bigint")


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _of_blocks(x: Column | str, start: Callable, step: Callable, end: Callable, tail: bool) -> Column:
    """A hash over the little-endian 8-byte blocks of a string or binary column, as a bigint of the same bits; null for null. The batch's values go side by side,
    longest first: start(n rows) gives their states, step(states, blocks) takes a block of each that has one, end(states, lengths) gives the hashes. With
    `tail` the last block is always short and carries the length in its highest byte."""

    @F.arrow_udf("bigint")
    def hashed(column: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        counts = lengths // 8 + 1 if tail else -(-lengths // 8)
        data, offsets = np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
        if buffers := column.buffers():
            width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
            if len(column) and buffers[1] is not None:
                offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            if buffers[2] is not None:
                data = np.frombuffer(buffers[2], np.uint8)
        begins = offsets[:-1][order]
        state, lane = start(len(order)), np.arange(8)
        for i in range(int(counts.max(initial=0))):
            n = int(np.searchsorted(-counts, -i))  # rows with more than i blocks
            at = begins[:n, None] + (8 * i + lane)
            inside = 8 * i + lane < lengths[:n, None]
            taken = np.where(inside, data[np.where(inside, at, 0)] if len(data) else np.uint8(0), np.uint8(0))
            if tail:
                taken[:, 7] = np.where(counts[:n] == i + 1, (lengths[:n] & 255).astype(np.uint8), taken[:, 7])
            block = np.ascontiguousarray(taken).view("<u8")[:, 0]
            for whole, part in zip(state, step([s[:n] for s in state], block)):
                whole[:n] = part
        out = np.empty(len(order), np.int64)
        out[order] = end(state, lengths.astype(np.uint64)).view(np.int64)
        return pa.array(out, mask=column.is_null().to_numpy(zero_copy_only=False))

    return hashed(col(x).cast("binary"))


def seahash(x: Column | str) -> Column:
    """seahash (the reference hash) of the bytes of a string or binary column, as a bigint of the same bits; null for null."""
    seeds, by = SEA, MULTIPLIER

    def diffused(v):
        v = v * np.uint64(by)
        v = v ^ ((v >> np.uint64(32)) >> (v >> np.uint64(60)))
        return v * np.uint64(by)

    def start(n):
        return [np.full(n, v, np.uint64) for v in seeds]

    def step(s, block):
        return [s[1].copy(), s[2].copy(), s[3].copy(), diffused(s[0] ^ block)]

    return _of_blocks(x, start, step, lambda s, lengths: diffused(s[0] ^ s[1] ^ s[2] ^ s[3] ^ lengths), False)


def siphash64(x: Column | str, key: tuple[int, int] = (0, 0)) -> Column:
    """sipHash-2-4 of the bytes of a string or binary column, as a bigint of the same bits; null for null."""
    seeds = [v ^ key[i & 1] for i, v in enumerate(SIP)]

    def rotated(v, n: int):
        return v << np.uint64(n) | v >> np.uint64(64 - n)

    def turn(a, b, c, d):
        a, c = a + b, c + d
        b, d, a = rotated(b, 13) ^ a, rotated(d, 16) ^ c, rotated(a, 32)
        a, c = a + d, c + b
        return a, rotated(b, 17) ^ c, rotated(c, 32), rotated(d, 21) ^ a

    def start(n):
        return [np.full(n, v, np.uint64) for v in seeds]

    def step(s, block):
        a, b, c, d = turn(*turn(s[0], s[1], s[2], s[3] ^ block))
        return [a ^ block, b, c, d]

    def end(s, lengths):
        a, b, c, d = s[0], s[1], s[2] ^ np.uint64(255), s[3]
        for _ in range(4):
            a, b, c, d = turn(a, b, c, d)
        return a ^ b ^ c ^ d

    return _of_blocks(x, start, step, end, True)


def siphash64_of(*xs: Column | str) -> Column:
    """sipHash64 over several columns: the hash of the two hashes' bytes, from left to right."""
    out = siphash64(xs[0])
    little = lambda h: F.reverse(F.regexp_replace(F.lpad(F.hex(h), 16, "0"), "(.)(.)", "$2$1"))
    for x in xs[1:]:
        out = siphash64(F.unhex(F.concat(little(out), little(siphash64(x)))))
    return out


def ordered(h: Column) -> Column:
    """A bigint whose order is that of the unsigned hash: the hash less 2^63."""
    return h.bitwiseXOR(lit64(1 << 63))


def unordered(h: Column) -> Column:
    return ordered(h)


def umod(h: Column, n: int) -> Column:
    """The unsigned hash modulo n, n below 2^31."""
    return F.get(F.transform(F.array(h), lambda x: F.pmod(F.pmod(high(x), F.lit(n)) * ((1 << 32) % n) + low(x), F.lit(n))), F.lit(0))  # h once


def udecimal(h: Column) -> Column:
    """The unsigned hash as a decimal(20,0)."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
