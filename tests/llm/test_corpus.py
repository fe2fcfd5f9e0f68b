"""Operators 1, 3, 5, 9 and the pipeline against brute force and planted cases."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekeel.llm import graph, htmltext, jaccard, linededup, quality


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(docs, edits, least):
    firsts = {}
    for d, t in sorted((d, t) for d, t in docs if t is not None and d is not None):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                firsts.setdefault(line, (d, n))
    long = [x for x in firsts if len(x) >= least]
    gone = {a for a in long for b in long if firsts[b] < firsts[a] and abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= edits}
    out = []
    for d, t in docs:
        keep = None if t is None else [x for n, x in enumerate(t.split("\n")) if d is None or not x.strip(" ") or (firsts[x] == (d, n) and x not in gone)]
        out.append((d, None if keep is None else "\n".join(keep)))
    return out


def edited(rng, line, k):
    for _ in range(k):
        i, o = rng.randrange(len(line)), rng.random()
        line = line[:i] + ("" if o < 0.3 else rng.choice("abé😀 ")) + line[i + (o < 0.7) :]
    return line


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé fg😀") for _ in range(rng.randint(20, 40))) for _ in range(12)]
    docs = []
    for d in range(30):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(1, 5))] + rng.choice([[], ["short"], [""], ["  "], ["shirt"]])
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (None, base[0] + "\n" + base[0]), (102, base[1] + "\n" + base[1])]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], "doc_id bigint, text string, mask string, line string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert len(got) == len(docs)
    for d, t in brute_lines(docs, linededup.EDITS, linededup.MIN_CHARS):
        assert got[d]["text"] == t, d
        assert got[d]["mask"] == "a" and got[d]["line"] == "b"
    assert got[102]["n_lines"] == 2 and got[100]["n_lines"] == 0
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_numbered_lines_share_segments(spark):
    rng = random.Random(12)
    lines = [f"Copyright of the whole work, page {rng.randint(10000, 99999)}" for _ in range(60)] + ["same line of many words here"] * 30
    docs = [(d, x) for d, x in enumerate(lines)] + [(900, "x" * 50_000), (901, "x" * 50_001), (902, ("word " * 400 + "\n") * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == dict(brute_lines(docs[:-3], linededup.EDITS, linededup.MIN_CHARS)) | {900: docs[-3][1], 901: "", 902: "word " * 400 + "\n"}


@pytest.mark.parametrize("shared", [10, 24, 36])
def test_lines_with_a_common_beginning_equal_brute_force(spark, shared, monkeypatch):
    """Thousands of lines that share one, two or nearly all of their segments; all near copies are found."""
    import duckdb

    monkeypatch.setattr(linededup, "HOT_KEY", 20)
    rng = random.Random(shared)
    head = "".join(rng.choice("abcdefgh ") for _ in range(shared))
    lines = [head + "".join(rng.choice("ijklmnopqrstuv") for _ in range(44 - shared)) for _ in range(1500)]
    lines += [edited(rng, rng.choice(lines), rng.choice([1, 2, 3])).replace("é", "y").replace("😀", "z") for _ in range(400)]  # levenshtein() counts bytes
    lines = sorted(set(lines), key=lambda x: rng.random())
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"] for r in linededup.dedup_lines(docs).where("n_kept = 0").collect()}
    con = duckdb.connect()
    table = docs.toPandas()  # noqa: F841
    want = {r[0] for r in con.sql("select distinct b.doc_id from table a join table b on a.doc_id < b.doc_id and abs(length(a.text) - length(b.text)) <= 2 and levenshtein(a.text, b.text) <= 2".replace("table", '"table"')).fetchall()}
    assert len(want) > 100 and got == want


def test_within_edits(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 16)))
        b = edited(rng, a, rng.randint(0, 4))
        if len(b) >= 5 and abs(len(a) - len(b)) <= 2:
            rows.append((a, b, levenshtein(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for k in (1, 2):
        ok = df.where(F.abs(F.length("a") - F.length("b")) <= k).withColumn("near", linededup.within_edits(linededup.characters(F.col("a")), linededup.characters(F.col("b")), k))
        assert ok.where(F.col("near") != (F.col("d") <= k)).count() == 0


def test_line_dedup_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a" * 30)], "doc_id bigint, text string")
    plan = linededup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_components(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in docs}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(s), label[d]) for d, s in sets}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(12))
    docs = []
    for family in range(6):
        words = [f"w{family}_{i}" for i in range(rng.choice([3, 5, 12, 60, 140]))]
        for _ in range(9):
            own = [w if rng.random() > 0.012 else "x" + str(rng.random()) for w in words]
            docs.append(" ".join(own) + rng.choice(["", "", " " + common]))
    docs += [None, "", "  \t", "One two", "ONE TWO", "one two three four five", common, common, "dup dup dup dup dup dup", "dup dup dup dup dup"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, c string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == brute_components(rows)
    assert jaccard.classes(df.limit(0)).count() == 0


def test_large_prefix_groups_lose_nothing(spark, monkeypatch):
    """Near copies of one text, some of them linked only through others, and a passage that many texts share."""
    for name, value in (("FRAGMENT_SHINGLES", 4), ("CELL_MEMBERS", 5), ("CELL_PAIRS", 3), ("ROWS", 2), ("BLOCK_SHINGLES", 500), ("FREQUENT", 8)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    base = [f"s{i}" for i in range(90)]
    docs = []
    for _ in range(60):
        own = list(base)
        for i in rng.sample(range(len(own)), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            own[i] = f"e{rng.randrange(12)}"
        docs.append(" ".join(own[: rng.choice([90, 90, 80])]))
    passage = " ".join(f"p{i}" for i in range(30))
    docs += [" ".join(f"q{k}_{i}" for i in range(k % 9)) + " " + passage for k in range(40)]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()} == brute_components(rows)


def test_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (3, b + " end"), (4, a), (1, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect())
    assert got == [(1, 0, 1), (1, 26, 1), (1, 26, 1), (3, 27, 1), (4, 26, 1)]


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (9, t + " tail")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.classes(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (9, 3)], key=str)
    assert sorted((r["doc_id"] for r in jaccard.one_of_each(df).collect()), key=str) == sorted([3, None], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)] + [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(20)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- c --><div class="ad">Buy now</div><article><h1>Head &amp; tail</h1><p><b>First  line<br>goes on<p>Second&nbsp;one</p>{more}<aside>Look</aside><section id="comments"><p>Nice!</p></section></article>
<form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_article_text(spark):
    rows = [(1, "http://h/1", PAGE.format(more="<ul><li>x</li><li>y <i>z</i></li></ul>")), (2, "http://h/2", PAGE.format(more="")), (3, None, None), (4, "http://k/", "plain &lt; text"), (5, "http://h/3", "<p>a<p>b</div></p><script>x"), (5, "http://h/3", "<p>a<p>b</div></p><script>x")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.page_texts(df).collect()}
    assert got[1]["text"] == "Head & tail\nFirst line goes on\nSecond one\nx\ny z"
    assert got[2]["text"] == "Head & tail\nFirst line goes on\nSecond one"
    assert got[3]["text"] == "" and got[4]["text"] == "plain < text" and got[5]["text"] == "a\nb"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert htmltext.page_texts(df.limit(0)).count() == 0


def test_wrapper_drops_constants_without_an_article(spark):
    rows = [(i, f"http://h/{i}", f"<body><div>Welcome to our site</div><div>Story {i} is told here</div></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["text"] for r in htmltext.page_texts(df).collect()} == {f"Story {i} is told here" for i in range(8)}
    wrapper = htmltext.infer_wrappers(df).first()
    assert len(wrapper["constants"]) == 1 and "#m" in htmltext.render(htmltext._load(wrapper["wrapper"]))


def test_fold_and_merge():
    a = htmltext.fold(list("axyxyxyb"))
    assert htmltext.render(a) == "a (x y)+ b"
    assert htmltext.render(htmltext.fold(list("pqpqqpqqq"))) in ("(p (q)+)+", "p q (p (q)+)+")
    b = htmltext.fold(list("axycb"))
    assert htmltext.render(htmltext.merge(htmltext.fold(list("ab")), htmltext.fold(list("acb")))) == "a (c)? b"
    assert "(c)?" in htmltext.render(htmltext.merge(a, b))


def test_long_streams_keep_their_constants(spark):
    def page(k):
        return f"<body><div>Story {k} is told here</div>" + "".join(f"<x{k}y{i}></x{k}y{i}>" for i in range(1200)) + "<div>All rights are ours</div></body>"

    df = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(6)], "page_id bigint, url string, html string")
    assert {r["text"] for r in htmltext.page_texts(df).collect()} == {f"Story {k} is told here" for k in range(6)}
    wrapper = htmltext.infer_wrappers(df).first()
    items = htmltext._load(wrapper["wrapper"])
    assert htmltext.constants_of(items) == set(wrapper["constants"]) and len(items) <= 2 * 2400 + 6  # no longer than one page


def test_opcodes_in_parts(monkeypatch):
    monkeypatch.setattr(htmltext, "PIECE", 7)
    rng = random.Random(2)
    for n in (0, 3, 30, 400):
        for letters in (2, 50, 1000):
            a, b = ([rng.randrange(letters) for _ in range(rng.randint(n // 2, n))] for _ in range(2))
            b = rng.choice([b, a[: n // 3] + b + a[n // 3 :]])
            at_a = at_b = 0
            for op, i1, i2, j1, j2 in htmltext.opcodes(a, b):
                assert (i1, j1) == (at_a, at_b) and (op == "equal") <= (a[i1:i2] == b[j1:j2])
                at_a, at_b = i2, j2
            assert (at_a, at_b) == (len(a), len(b))
            merged = [x[1] for x in htmltext.merge([("t", str(x), False) for x in a], [("t", str(x), False) for x in b])]
            rest = iter(merged)
            assert all(str(x) in rest for x in a)
            rest = iter(merged)
            assert all(str(x) in rest for x in b)


def test_unclosed_elements_at_any_depth(spark):
    options = "<select>" + "<option>land" * 300
    rows = [
        (1, f"<article><p>before</p>{options}</select><p>after</p></article><p>out</p>"), (2, f"<p>before</p><form>{options}</form><p>after</p>"),
        (3, "<article>" + "<b>" * 300 + "in</article><p>out</p>"), (4, f"a {options}<select><option>b</select> c"),
        (5, "a <select><optgroup><option>b<optgroup><option>c</select> d<article>e<select><option>f</article>g"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(df).collect()}
    assert got == {1: "before\nafter", 2: "before\nafter", 3: "in", 4: "a\nc", 5: "e"}
    page = htmltext.Page(f"a{options}<select><option>b<p>c<option>d</select>e")
    assert page._stack == [] and max(len(x) for x in page._open.values()) == 0


def brute_text(html):
    """Main text of a page by its own groups."""
    page = htmltext.Page(html)
    stream = page.stream()
    items, places = htmltext.fold_with_places([t for t, _, _ in stream], [i for _, _, i in stream])
    levels = {}
    htmltext.spread(htmltext.match(items, items), places, levels)
    return "\n".join(page.blocks(htmltext.main_places(page, levels)))


def test_marks_of_boilerplate():
    for html, want in (
        ("<article><p>one</p><section class='related-work'><h2>h</h2><p>Body</p></section></article>", "one\nh\nBody"),
        ("<article><p>one</p><section class='related-posts'><h2>h</h2></section><div class='site_footer'>f</div></article>", "one"),
        ('<article><p class="share">The share price rose</p><div class="share">Tell others</div><p class="ad">Buy</p></article>', "The share price rose"),
        ("<article><p data-x=it's>Hello, don't go</p><p title='a > b'>second</p></article>", "Hello, don't go\nsecond"),
        ("<aside><article>teaser</article></aside><main>m<article>a</article></main>", "a"),
        ("<main><p>m</p><nav>n</nav></main><p>else</p>", "m"),
        ("<div class=sidebar><article>a</article></div>x", "a"),
        ("<p><a href=x>All of it a link</a></p><p>two</p>", "All of it a link\ntwo"),
        ("<ul><li><a>A</a></li><li><a>B</a></li><li><a>C</a></li></ul><p>text</p>", "text"),
        ("<p>a <b>b</b> <i>c</i></p></x></ y><p>d</p><p attr", "a b c\nd"), ("<title>t</title><script>x<p></script>y<textarea>z", "y"), ("", ""), ("a < b", "a < b"),
    ):
        assert brute_text(html) == want, html


@pytest.mark.parametrize("part", ["<b ", '<b x=">" ', "<div>", '<a href="x>', "<!-", "<option>x", "<p>x</div>", "<", "</"])
def test_broken_markup_is_read_in_one_pass(part):
    import time

    began = time.process_time()
    htmltext.Page(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8


def test_menus_of_the_wrapper_and_repeated_rows(spark, monkeypatch):
    """On one page of the host the list has text beside its links, so it is no menu there; on the other host it is."""
    def page(h, k):
        words = " with words" if h == "m" and k == 0 else ""
        return f"<body><div>Top of site</div><ul>{f'<li><a>L{k}</a>{words}</li>' * 3}</ul><p>Story {k} of {h}</p></body>"

    rows = [(k, f"http://{h}/{k}", page(h, k)) for h in "mn" for k in range(6)]
    df = spark.createDataFrame(rows + rows[:3], "page_id bigint, url string, html string").repartition(4)
    seen = []
    for size in (htmltext.BROADCAST_BYTES, 0):
        monkeypatch.setattr(htmltext, "BROADCAST_BYTES", size)
        monkeypatch.setattr(htmltext, "SALT_PAGES", 2)
        seen.append(sorted((r["url"], r["text"]) for r in htmltext.page_texts(df).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 15
    got = dict(seen[0])
    assert got["http://n/2"] == "Story 2 of n" and got["http://m/2"] == "L2\nL2\nL2\nStory 2 of m" and got["http://m/0"] == "L0 with words\n" * 3 + "Story 0 of m"


class Plain(HTMLParser):
    """Text of the articles of well-formed pages, else of all but nav, footer, header and the like, by the standard library's parser."""

    SKIP = {"nav", "footer", "header", "aside", "form", "script", "style", "title", "head"}
    BREAKS = {"p", "div", "h1", "h2", "h3", "li", "ul", "section", "article", "main", "body", "html", "nav", "footer", "header", "aside"}

    def __init__(self, html, inside):
        super().__init__(convert_charrefs=True)
        self.inside, self.open, self.out, self.part = inside, [], [], ""
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.part.split()):
            self.out.append(text)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        self.part += " " if tag == "br" else ""
        if tag in self.BREAKS:
            self.flush()
        if tag not in ("br", "img", "meta", "link"):
            self.open.append(tag if dict(attrs).get("class") not in ("ad", "comments", "reader-comments") else "aside")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.flush()
        while self.open and tag in [*self.open, "aside"] and (self.open[-1] != tag):
            if self.open[-1] == "aside" and tag == "div":
                break
            self.open.pop()
        if self.open:
            self.open.pop()

    def handle_data(self, data):
        if not self.SKIP & set(self.open) and (not self.inside or self.inside in self.open):
            self.part += data


def plain(html):
    return "\n".join(Plain(html, "article" if "<article" in html else "main" if "<main" in html else None).out)


def test_pages_equal_another_parser(spark):
    """Given pages, repeated pages, mirrors under one host, pages without an article: by the standard library's parser, without wrappers."""
    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rows = [(i, u, h) for i, u, h in given if h]
    day = "<html><body><nav><a href='/'>Home</a></nav><div><p>The story of the day is told here.</p></div></body></html>"
    rows += [(10_000 + i, f"http://mirror/{i}", day) for i in range(4)] + [(10_010, "http://single/", day)]
    rows += [(10_020 + i, f"http://main/{i}", f"<main><h1>Title {i}</h1><p>Text {i} &amp; more<br>goes on</p><div class='reader-comments'><p>Nice!</p></div></main><footer>f</footer>") for i in range(6)]
    rows += [(10_030 + i, f"http://plain/{i}", f"<body><div><p>Part one of {i}.</p><p>Part two of {i}.</p></div></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(df).collect()}
    want = {i: plain(h) for i, _, h in rows}
    assert want[10_000] == "The story of the day is told here." and want[10_020] == "Title 0\nText 0 & more goes on"
    assert got == want


def test_wrappers_of_varied_pages_stay_bounded(spark):
    rng = random.Random(8)

    def page(k):
        body = "".join(rng.choice([f"<p>Words {k} {i}</p>", f"<ul>{'<li>x</li>' * rng.randint(1, 4)}</ul>", f"<div><h2>Part {i}</h2><p>y {k}</p></div>", f"<table><tr><td>{i}</td></tr></table>"]) for i in range(rng.randint(5, 60)))
        return f"<body>{body}</body>"

    pages = [(k, f"http://varied/{k}", page(k)) for k in range(300)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    wrapper = htmltext._load(htmltext.infer_wrappers(df).first()["wrapper"])
    assert sum(1 for _ in htmltext.leaves(wrapper)) <= htmltext.WRAPPER_LEAVES
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(df).collect()}
    assert all(f"Words {k} " in text or f"y {k}" in text or text for k, text in got.items()) and len(got) == 300


def test_what_a_full_wrapper_leaves_out_is_counted(spark):
    """The pages seen most fill the wrapper. Of the others, a text that most pages share is a constant, a list with text on some page is no menu, and one without is."""
    full = "".join(f"<x{i}></x{i}>" for i in range(htmltext.WRAPPER_LEAVES))
    rows = [(i, f"http://h/{i}", f"<body><div>Long {i}</div>{full}</body>") for i in range(4)]

    def other(k):
        near = "".join(f"<li><a href=x>Near {k} {i}</a>{' said of it' if k % 2 else ''}</li>" for i in range(2))
        far = "".join(f"<dd><a href=x>Far {k} {i}</a></dd>" for i in range(2))
        return f"<body><z{k}></z{k}><p>Story {k}</p><section><ul>{near}</ul></section><section><dl>{far}</dl></section><pre>All rights are ours</pre></body>"

    rows += [(10 + k, f"http://h/{10 + k}", other(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    host = htmltext.infer_wrappers(df).first()
    assert not set(htmltext.leaves(htmltext._load(host["wrapper"]))) & {"<ul>", "<z1>", "<pre>"}
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(df).collect()}
    tail = lambda k: " said of it" if k % 2 else ""
    want = {10 + k: "\n".join([f"Story {k}", *(f"Near {k} {i}{tail(k)}" for i in range(2))]) for k in range(6)}
    assert got == {i: f"Long {i}" for i in range(4)} | want


def test_groups_note_texts_that_they_do_not_hold():
    link, text = (htmltext.fold(list(x) * 2) for x in (["<li>", "#l", "</li>"], ["<li>", "#l", "#m", "</li>"]))
    kept = htmltext.merge(link, text, grow=False)
    assert list(htmltext.leaves(kept)) == list(htmltext.leaves(link)) and not htmltext.is_menu(kept[0]) and htmltext.is_menu(link[0])
    again = htmltext.merge(htmltext._load(htmltext._dump(kept)), link)
    assert htmltext.kinds(again[0]) == 3 and htmltext.render(again) == "(<li> #l </li>)+"
    assert [htmltext.match(link, w) for w in (kept, link, [])] == [[[-1, 0, -1]], [[-1, -1, -1]], [[-1, -1, -1]]]


def test_every_row_of_an_article_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] or "" for r in df.select("page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in htmltext.page_texts(df).collect()}
    assert got == {i: brute_text(h) for i, h in html.items()}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.15
    counts = {}
    rates = [(0.6, 0.02), (0.5, 0.03), (0.4, 0.01), (0.7, 0.05)]
    votes = np.stack([np.where(rng.random(20000) < np.where(truth, b, g), quality.BAD, quality.NONE) for b, g in rates] + [np.where(rng.random(20000) < np.where(truth, 0.05, 0.9), quality.GOOD, quality.NONE)], axis=1)
    for row in map(tuple, votes.tolist()):
        counts[row] = counts.get(row, 0) + 1
    share, table = quality.fit_accuracies(counts, 0.1)
    assert abs(share - 0.15) < 0.02
    for k, (bad, good) in enumerate(rates):
        assert abs(table[k, quality.BAD, quality.BAD] - bad) < 0.06 and abs(table[k, quality.GOOD, quality.BAD] - good) < 0.02
    assert ((quality.posteriors(votes, share, table) > 0.5) == truth).mean() > 0.96


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_votes_see_the_whole_text():
    def votes(words):
        text = " ".join(words).encode()
        return quality.quality_votes(text, text.split())

    start = [f"w{i} of" for i in range(200)]  # 400 usual words
    assert votes(start)[-1] == quality.GOOD
    for late, labeller in (([f"w{i % 9}" for i in range(4000)], 5), ([f"w{i}ord!!" for i in range(900)], 1), ([f"W{i}" for i in range(900)], 3)):
        got = votes(start + late)
        assert got[labeller] == quality.BAD and got[-1] == quality.NONE
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab!!**  \n\x1c\u2003") for _ in range(rng.randint(0, 30))).encode()
        raw = np.frombuffer(text, np.uint8)
        assert quality.doubled_ends(raw, quality._CLASS[raw]) == sum(w[-1] == w[-2] and w[-1] in b"*!" for w in text.split() if len(w) > 2)


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, train).join(held, "doc_id").toPandas()
    low = got["low_quality"] >= 0.5
    assert (low == (got["quality"] == 0)).mean() > 0.95
    good = got[(got["quality"] == 1) & (got["toxic"] == 0)]
    assert good["keep"].mean() > 0.97
    english = docs.where("lang = 'en'").select("doc_id").toPandas()["doc_id"]
    toxic = got[(got["toxic"] == 1) & got["doc_id"].isin(english)]
    assert (~toxic["keep"]).mean() > 0.9


def test_recall_by_language_and_class(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert set(got["lang"]) == {"en", "de", "es", "fr"}
    for lang, own in got.groupby("lang"):
        assert (own[own["quality"] == 0]["low_quality"] >= 0.5).mean() >= 0.9, lang
        assert (~own[own["toxic"] == 1]["keep"]).mean() >= 0.9, lang
        assert own[(own["quality"] == 1) & (own["toxic"] == 0)]["keep"].mean() >= 0.95, lang


def test_cover_takes_no_words_of_copies():
    """The insult explains all toxic rows; the words that five copies of one of them share are not learnt, nor are those of all rows."""
    toxic = list(range(40))
    stems = [b"bad", b"copy1", b"copy2", b"all", b"rare"]
    holders = [toxic, [0, 1, 2, 3, 4], [0, 1, 2, 3, 4], toxic, [7, 8, 9]]
    assert quality.cover(stems, holders, [3, 0, 0, 400, 0], 40, 400) == {b"bad"}
    assert quality.cover([], [], [], 0, 5) == frozenset()


def test_few_words_are_little_evidence():
    def votes(text):
        return quality.quality_votes(text.encode(), text.encode().split())

    for text in ("OK", "A short one.", "NASA said so", "no no", "Yes!"):
        assert quality.BAD not in votes(text), text
    assert quality.BAD in votes("In. In. In. In. In. In.") and quality.BAD in votes("Great stuff!! Buy!!") and quality.BAD in votes("a | b | c | d")
    words = quality.Words(frozenset([b"vexi"]), 3)
    assert quality.toxic_votes(words.codes(b"vexing")).count(quality.BAD) == 2 and quality.toxic_votes(words.codes(b"Vexing" + b" w" * 900))[-1] == quality.GOOD
    assert quality.toxic_votes(words.codes(b"you idiot, a b c d vexing e"))[0] == quality.BAD and quality.toxic_votes(words.codes(None))[-1] == quality.GOOD


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "A short one.", "c"), (None, "Another plain sentence of usual words.", "d")], "doc_id bigint, text string, keep string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert got[1] is False and got[2] is False
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and "a" not in {r["keep"] for r in kept.collect()}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lakekeel.llm import decontaminate

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, d)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        step = spark.read.parquet(path)
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    assert decontaminate.contamination(step, bench).where("contaminated").count() == 0
    assert jaccard.classes(step).where("doc_id <> component_id").count() == 0
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == step.count() > 0
