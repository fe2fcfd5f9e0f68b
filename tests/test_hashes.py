"""64-bit hashes against published vectors and a plain form."""

from pyspark.sql import functions as F

from lakekeel.functions import hashes as H

ALL = (1 << 64) - 1


def rot(x, n):
    return (x << n | x >> (64 - n)) & ALL


def diffuse(x):
    x = x * H.MULTIPLIER & ALL
    x ^= (x >> 32) >> (x >> 60)
    return x * H.MULTIPLIER & ALL


def sea(data):
    lanes = list(H.SEA)
    for i in range(0, len(data), 8):
        lanes = [*lanes[1:], diffuse(lanes[0] ^ int.from_bytes(data[i : i + 8], "little"))]
    return diffuse(lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ len(data))


def sip(data, key=(0, 0)):
    a, b, c, d = (v ^ key[i & 1] for i, v in enumerate(H.SIP))

    def turn(a, b, c, d):
        a, c = (a + b) & ALL, (c + d) & ALL
        b, d, a = rot(b, 13) ^ a, rot(d, 16) ^ c, rot(a, 32)
        a, c = (a + d) & ALL, (c + b) & ALL
        return a, rot(b, 17) ^ c, rot(c, 32), rot(d, 21) ^ a

    whole = len(data) // 8 * 8
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)] + [int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]
    for m in words:
        a, b, c, d = turn(*turn(a, b, c, d ^ m))
        a ^= m
    c ^= 255
    for _ in range(4):
        a, b, c, d = turn(a, b, c, d)
    return a ^ b ^ c ^ d


def test_hashes(spark):
    key = (0x0706050403020100, 0x0F0E0D0C0B0A0908)
    # Published vectors of both hashes.
    assert sea(b"to be or not to be") == 1988685042348123509
    assert sip(bytes(range(15)), key) == 0xA129CA6149BE45E5
    assert sip(b"") == 0x1E924B9D737700D7
    texts = [bytes(i * 37 % 256 for i in range(n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 24, 31)] + [b"to be or not to be", b"\xff" * 300]
    rows = spark.createDataFrame([(bytearray(t),) for t in texts] + [(None,)], "x binary")
    own = rows.select("x", H.seahash("x").alias("sea"), H.siphash64("x").alias("sip"), H.siphash64("x", key).alias("keyed")).collect()
    for r in own:
        if r["x"] is None:
            assert r["sea"] is r["sip"] is r["keyed"] is None
        else:
            t = bytes(r["x"])
            assert (r["sea"] & ALL, r["sip"] & ALL, r["keyed"] & ALL) == (sea(t), sip(t), sip(t, key))


def test_unsigned_readings(spark):
    values = [0, 1, 5999, 6000, (1 << 63) - 1, 1 << 63, (1 << 63) + 12345, ALL]
    rows = spark.createDataFrame([(H.signed(v),) for v in values], "h bigint")
    h = F.col("h")
    got = rows.select("h", H.umod(h, 6000).alias("m"), H.udecimal(h).alias("d"), H.ordered(h).alias("o"), H.unordered(H.ordered(h)).alias("back")).collect()
    assert [(r["m"], int(r["d"]), r["o"], r["back"]) for r in got] == [(v % 6000, v, v - (1 << 63), H.signed(v)) for v in values]
    two = spark.createDataFrame([("s3://a", "c-1"), ("", "x")], "a string, b string")
    word = lambda t: sip(t.encode()).to_bytes(8, "little")
    assert [r[0] & ALL for r in two.select(H.siphash64_of("a", "b")).collect()] == [sip(word(a) + word(b)) for a, b in (("s3://a", "c-1"), ("", "x"))]


def test_hashes_of_a_batch_of_all_lengths(spark):
    """Texts of every length side by side, in no order, with nulls and slices between them; no step of the plan is interpreted row by row."""
    texts = [bytes((i * n + 11) % 256 for i in range(n)) for n in [*range(0, 70), 500, 3, 64, 0, 8, 8, 1000, 7]]
    rows = spark.createDataFrame([(i, bytearray(t) if i % 9 else None) for i, t in enumerate(texts)], "i int, x binary").coalesce(1)
    own = rows.where("i > 4").select("i", H.seahash("x").alias("sea"), H.siphash64("x").alias("sip"))
    assert "ArrowEvalPython" in own._jdf.queryExecution().toString()
    for r in own.collect():
        assert (r["sea"], r["sip"]) == (None, None) if r["i"] % 9 == 0 else (r["sea"] & ALL, r["sip"] & ALL) == (sea(texts[r["i"]]), sip(texts[r["i"]]))
