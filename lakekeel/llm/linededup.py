"""Operator 1 [native]: line dedup by a segment-partition edit join.

A line is dropped if an equal line stands earlier; earlier means a smaller (id, line number). A line of at least
MIN_CHARS code points is also dropped if one of these within EDITS edits (insertions, deletions, substitutions of code points) stands
earlier. Lines without any character but spaces always stay. What stays is joined by line feeds again.

Method. Equal lines are found by hash: an aggregation gives the first place of each line. For the edit join every
line is cut into EDITS + 1 segments, whose places depend on its length alone; two lines within EDITS edits share a
segment (one segment is untouched), nearly in its place. Each line gives its segments to an index keyed by length,
segment number and content, and probes it with those of its substrings that can be such a segment of a line of
equal or smaller length (positions that leave too many edits on one side are left out). Keys that
only one line has are dropped at once; of the lines that are left, pairs that meet and have similar letter counts are verified by banded bit-parallel edit distance: the band of 2 * EDITS + 1 diagonals is one
integer, advanced by a code point a step.

Keys that more than HOT_KEY lines share would make pairs of all these. Pairs that meet only there are sought among these lines alone by FINE segments in place of
EDITS + 1: at most EDITS of them are touched, so of any EDITS + 1 segments of a line at least one is whole in its copy. Each line gives only its EDITS + 1 rarest
segments to the index, which leaves out a beginning that all lines share, and probes with all it has. Nothing is lost by this; pairs are those of lines that share a rare part.

All of it is DataFrame operations; no Python runs on the data. Of the most frequent lines (a list of bounded
size) only the first place enters the edit join, so copies do not multiply there. Lines that share a segment but differ in
the counts of letters or digits by more than the edits can change never become pairs.

Defined cases: null text stays null (no lines); a null id takes no part and keeps all its lines; rows with the same
id count as one document for order, and a line that stays does so in each of them; any length; an empty table gives an empty result;
further columns pass through, whatever their names (counts get other names if theirs are taken). Equality of lines is that of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Largest edit distance of lines that count as copies.
EDITS = 2
#: Shorter lines, in code points, are compared for equality only.
MIN_CHARS = 20
#: Most frequent lines that are broadcast with their first place.
FREQUENT_LINES = 1 << 16
#: Shared keys whose line ids may be broadcast for verification; those of more are joined by shuffling.
BROADCAST_IDS = 1 << 21
#: Entries of a key beyond which its lines are compared by their rarest of FINE segments.
HOT_KEY, FINE = 200, 12
#: Characters whose counts filter candidates; digits keep numbered lines that share their segments apart.
LETTERS = "etaoinsrhldcumpg0123456789"


def cut(length: Column | int, i: int, parts: int) -> Column:
    """Where segment i of `parts` of a line of that length begins."""
    return F.floor(length * F.lit(i) / F.lit(parts)).cast("int")


def segment_key(length: Column, i: int, start: Column, past: Column, text: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(text, start + 1, past - start))


def segment_keys(text: Column, n: Column, edits: int) -> Column:
    """Structs (key, shorter): the line's own segments (shorter = -1, for the index), then the substrings that can be a
    segment of a line shorter by `shorter`."""
    out = [F.struct(segment_key(n, i, cut(n, i, edits + 1), cut(n, i + 1, edits + 1), text).alias("key"), F.lit(-1).alias("shorter")) for i in range(edits + 1)]
    for shorter in range(edits + 1):
        m = n - F.lit(shorter)
        for i in range(edits + 1):
            start, past = cut(m, i, edits + 1), cut(m, i + 1, edits + 1)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                out.append(F.struct(segment_key(m, i, start + shift, past + shift, text).alias("key"), F.lit(shorter).alias("shorter")))
    return F.array(*out)


def fine_keys(text: Column, n: Column, edits: int, fine: int) -> tuple[Column, Column]:
    """The line's own keys by `fine` segments, and structs (key, shorter) of the substrings that can be such segments of a line shorter by
    `shorter`: those moved by a shift need |shift| edits before and |shorter - shift| after them. Written as transforms over small arrays, since a
    hundred expressions in one generated method cost much memory to compile."""
    begin = lambda m, i: F.floor(m * i / F.lit(fine)).cast("int")
    key = lambda m, i, start, past: F.xxhash64(m, i, F.substring(text, start + 1, past - start))
    segments = F.sequence(F.lit(0), F.lit(fine - 1))
    moves = [(shorter, shift) for shorter in range(edits + 1) for shift in range(-edits, edits + 1) if abs(shift) + abs(shorter - shift) <= edits]
    table = F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(b).alias("shift")) for a, b in moves])

    def moved(move: Column) -> Column:
        m, shift = n - move["shorter"], move["shift"]

        def probe(i: Column) -> Column:
            start, past = begin(m, i), begin(m, i + 1)
            inside = (start + shift >= 0) & (past + shift <= n) & (past > start)
            return F.struct(F.when(inside, key(m, i, start + shift, past + shift)).alias("key"), move["shorter"].alias("shorter"))

        return F.transform(segments, probe)

    own = F.transform(segments, lambda i: key(n, i, begin(n, i), begin(n, i + 1)))
    return own, F.filter(F.flatten(F.transform(table, moved)), lambda p: p["key"].isNotNull())


def meet(probe: DataFrame, index: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of different lines that meet in a key and have similar letter counts. probe (key, a, letters_a, shorter), index (key, b, letters_b)."""
    apart = (F.col("a") != F.col("b")) & ((F.col("shorter") > 0) | (F.col("a") < F.col("b")))
    return probe.join(index, (probe["key"] == index["key"]) & apart & near_counts("letters_a", "letters_b", edits)).select("a", "b")


def meet_in_rare_segments(lines: DataFrame, edits: int, fine: int) -> DataFrame:
    """Pairs of lines (id, line, letters) that share one of the rarest segments of the shorter one."""
    n = F.length("line")
    own, probes = fine_keys(F.col("line"), n, edits, fine)
    keys = materialise(lines.select("id", F.explode(F.array_distinct(own)).alias("key")))
    counted = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key")
    # equal segments have different keys in different places, so a line has `fine` of them unless some are empty
    rarest = counted.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "key"))), 1, edits + 1).alias("rare"))
    letters = lines.select("id", "letters")
    index = rarest.select("id", F.explode("rare.key").alias("key")).join(letters, "id").select("key", F.col("id").alias("b"), F.col("letters").alias("letters_b"))
    probe = lines.select("id", F.explode(probes).alias("p"), "letters").select("p.key", F.col("id").alias("a"), F.col("letters").alias("letters_a"), "p.shorter")
    return meet(probe, index, edits)


def letter_counts(text: Column, n: Column) -> Column:
    """Counts of some letters."""
    return F.array(*[n - F.length(F.replace(text, F.lit(letter), F.lit(""))) for letter in LETTERS])


def near_counts(a: str, b: str, edits: int) -> Column:
    """An edit changes two counts by one at most."""
    apart = None
    for i in range(len(LETTERS)):
        one = F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
        apart = one if apart is None else apart + one
    return apart <= 2 * edits


def _let(value: Column, body) -> Column:
    """body(value), computing value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Banded bit-parallel edit distance of two arrays of characters is at most `edits` (lengths at least `edits`)."""
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def advance(acc: Column, j: Column) -> Column:
        char = F.get(b, j)
        match = None
        for d in range(width):
            bit = F.when(F.get(a, j + (d - edits)) == char, F.lit(1 << d)).otherwise(F.lit(0))
            match = bit if match is None else match + bit
        vp, vn = acc["vp"], acc["vn"]

        def with_match(x: Column) -> Column:
            d0 = (x.bitwiseAND(vp) + vp).bitwiseAND(mask).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)

            def with_diagonal(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
                hn = d0.bitwiseAND(vp)

                def with_horizontal(h: Column) -> Column:
                    hp, hn = h["hp"], h["hn"]
                    down = F.shiftright(d0, 1)
                    row = F.size(a) - 1 - j + edits
                    step = F.when(j < F.size(a) - edits, F.when(d0.bitwiseAND(1 << 2 * edits) == 0, 1).otherwise(0)).otherwise(
                        F.when(hp.bitwiseAND(_bit(row)) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(_bit(row)) != 0, 1).otherwise(0)
                    )
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (acc["dist"] + step).alias("dist"),
                    )

                return _let(F.struct(hp.alias("hp"), hn.alias("hn")), with_horizontal)

            return _let(d0, with_diagonal)

        return _let(match, with_match)

    def _bit(row: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << i) for i in range(width)]), F.greatest(F.lit(1), F.least(F.lit(width), row + 1)))

    start = F.struct(F.lit(mask >> edits << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, advance, lambda acc: acc["dist"]) <= edits


def characters(text: Column) -> Column:
    """Code points as an array."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, counts: tuple[str, str] | None = ("n_lines", "n_kept")
) -> DataFrame:
    """The documents with their text's dropped lines taken out; all columns stay. counts: names for the numbers of
    lines before and after, or None."""
    spark = docs.sparkSession
    if min_chars < 2 * edits + 1:
        raise ValueError("min_chars must exceed twice the edits")
    every = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    lines = every.where(F.trim("line") != "").withColumn("n", F.length("line")).withColumn("id", F.xxhash64("line"))
    firsts = materialise(lines.groupBy("id").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("copies")))

    lines = lines.where(F.col("n") >= min_chars)
    frequent = firsts.where("copies > 1").orderBy(F.desc("copies"), "id").limit(FREQUENT_LINES)
    known = frequent.select("id", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_no"))
    single = lines.join(F.broadcast(known), "id", "left").where("first_doc is null or (doc = first_doc and line_no = first_no)")
    entries = single.select("id", F.explode(segment_keys(F.col("line"), F.col("n"), edits)).alias("p")).select("id", "p.key", "p.shorter")
    # keys that an index entry shares with another line: few, so all that follows is small
    w = Window.partitionBy("key")
    seen = entries.withColumn("low", F.min("id").over(w)).withColumn("high", F.max("id").over(w)).withColumn("least", F.min("shorter").over(w)).withColumn("size", F.count("*").over(w))
    shared = materialise(seen.where("low <> high and least < 0").select("key", "id", "shorter", (F.col("size") > HOT_KEY).alias("hot")))

    wanted = shared.select("id").distinct()
    if shared.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = materialise(lines.join(wanted, "id").groupBy("id").agg(F.first("line").alias("line")))
    letters = materialise(texts.select("id", letter_counts(F.col("line"), F.length("line")).alias("letters")))
    own = shared.where("not hot").select("key", "id", "shorter").dropDuplicates(["key", "id", "shorter"]).join(letters, "id")
    index = own.where("shorter < 0").select("key", F.col("id").alias("b"), F.col("letters").alias("letters_b"))
    probe = own.where("shorter >= 0").select("key", F.col("id").alias("a"), F.col("letters").alias("letters_a"), "shorter")
    met = meet(probe, index, edits)
    crowd = materialise(shared.where("hot").select("id").distinct())
    if not crowd.isEmpty():
        met = met.unionByName(meet_in_rare_segments(texts.join(crowd, "id").join(letters, "id"), edits, FINE))
    pairs = materialise(met.distinct())
    chars = texts.select("id", characters(F.col("line")).alias("chars"))
    checked = (
        pairs.join(chars.select(F.col("id").alias("a"), F.col("chars").alias("x")), "a")
        .join(chars.select(F.col("id").alias("b"), F.col("chars").alias("y")), "b")
        .where((F.abs(F.size("x") - F.size("y")) <= edits) & within_edits(F.col("x"), F.col("y"), edits))
        .select("a", "b")
    )
    near = materialise(checked)
    place = firsts.select("id", "first")
    both = near.join(place.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(place.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    dropped = both.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()

    # the lines that stay, as one text of 0 and 1 per document
    kept = firsts.join(dropped, "id", "left_anti").select(F.col("first.doc").alias("kept_doc"), F.col("first.line_no").alias("no"))
    listed = kept.groupBy("kept_doc").agg(F.sort_array(F.collect_list("no")).alias("nos"))
    gaps = F.transform("nos", lambda no, i: F.concat(F.repeat(F.lit("0"), no - F.when(i == 0, F.lit(-1)).otherwise(F.get("nos", i - 1)) - 1), F.lit("1")))
    of, mask, stays = fresh(docs.columns, "kept_doc", "mask", "kept_lines")
    masks = listed.groupBy(F.col("kept_doc").alias(of)).agg(F.first(F.split(F.array_join(gaps, ""), "")).alias(mask))
    pieces = F.split(text_col, "\n")
    stay = F.filter(pieces, lambda line, i: (F.trim(line) == "") | (F.coalesce(F.get(mask, i), F.lit("0")) == "1") | F.col(id_col).isNull())
    out = docs.join(masks, docs[id_col] == masks[of], "left").withColumn(stays, stay)
    columns = [F.array_join(stays, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        before, after = fresh(docs.columns, *counts)
        columns += [F.coalesce(F.size(pieces), F.lit(0)).cast("bigint").alias(before), F.coalesce(F.size(stays), F.lit(0)).cast("bigint").alias(after)]
    return out.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
with line as (
  select doc_id, i - 1 as line_no, s[i] as line from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null), unnest(range(1, len(s) + 1)) as u(i)),
firsts as (select line, min(doc_id * 10000000 + line_no) as place from line where trim(line) <> '' group by line),
sized as (select line, place, length(line) as n from firsts where length(line) >= {MIN_CHARS}),
probe as (select line, place, n, n - d as m from sized, (values (0), (1), (2)) t(d)),
shifts as (select * from (values (-2), (-1), (0), (1), (2)) t(s)),
middle as (select line, place, n, substr(line, n // 2 - 2, 6) as part, n // 2 - 2 as at from sized),
shifted as (select p.line, p.place, p.m, substr(p.line, p.m // 2 - 2 + s, 6) as part from probe p, shifts),
pair as (
  select x.line as a, x.place as pa, y.line as b, y.place as pb from probe x join sized y on y.n = x.m and left(x.line, 6) = left(y.line, 6)
  union select x.line, x.place, y.line, y.place from probe x join sized y on y.n = x.m and right(x.line, 6) = right(y.line, 6)
  union select x.line, x.place, y.line, y.place from shifted x join middle y on y.n = x.m and x.part = y.part),
near as (select distinct case when pa > pb then a else b end as line from pair where a <> b and levenshtein(a, b) <= {EDITS}),
stays as (
  select l.doc_id, l.line_no, l.line from line l left join firsts f on f.line = l.line
  where trim(l.line) = '' or (f.place = l.doc_id * 10000000 + l.line_no and l.line not in (select line from near))),
text_of as (select doc_id, count(*) as n_kept, string_agg(line, chr(10) order by line_no) as t from stays group by doc_id),
size_of as (select doc_id, count(*) as n_lines from line group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_kept, 0) as bigint) as n_kept,
       cast(length(coalesce(t, '')) as bigint) as n_chars, sha256(coalesce(t, '')) as text_sha256
from documents d left join size_of using (doc_id) left join text_of using (doc_id)
"""
