"""Operator 3: main text of web pages by union-free wrapper inference.

Method. A page becomes a stream of tags and texts; a text's token says whether it stands in an article, in a main part, in
boilerplate, in a link or elsewhere. Runs of equal parts fold into repeated groups. The folded
streams of a host are aligned, a few at a time and level by level: tokens that agree stay, those that do not become
optional, repeated groups merge with their likes, and texts that differ become text slots while texts that most pages
of the host share stay as constants. What remains is the host's wrapper, a regular expression without unions.
Then each page is matched against its host's wrapper, and its texts are those of the slots that hold main text: article slots if the page fills
any, else slots of a main part, else all slots but those of boilerplate and of menus; where a main part has more text outside its articles than these hold, they are
teasers beside it, and both count. Constants are no slots, unless a page would have no text at all without them. A menu is a repeated group of the wrapper with links and no
other text on any page of the host; a group that the wrapper does not match is judged with all those of the host that are alike (`alike`).

A wrapper takes up new parts as long as it has no more than WRAPPER_LEAVES tokens; after that, pages still merge with the parts it has.
So a wrapper is no longer than that or the longest page, however varied a host is. What it leaves out is counted apart, over all pages: its groups note
links and texts that their bodies do not hold, constants are those of the host's table, and groups that it lacks are aggregated by host and place. Pages count by
their distinct streams of text, so a crawl's repeated rows and mirrors change nothing.

Blocks are what block-level tags separate; inside a block white space turns into one space, character references
are decoded, blocks without text vanish, and the others are joined by line feeds in page order.

Tags are read in one pass that follows the attribute states of HTML; a tag that never ends takes the rest of the page with it.
A class, id or role word marks boilerplate if all parts of it are known (related-posts, not related-work), or if its last part names
boilerplate outright (reader-comments, legalNotice; not no-sidebar); elements of running text are marked by words for adverts only.

Hot hosts. Equal streams of a host are counted before they are gathered, and no task aligns more than FAN_IN of them;
texts are counted with partial sums. Wrappers are broadcast if they are small in sum (BROADCAST_BYTES); else pages are dealt by host and
salt, and a wrapper travels once for each salt.

Defined cases: null html is an empty page (empty text); a null url has the host ''; unclosed, unopened and crossed tags are
tolerated; any length; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, ship, utf8
from .urlfilter import canonical

#: Streams or wrappers that one task aligns at a time.
FAN_IN = 16
#: Share of a host's pages (and least number of them) that make a text a constant of its template.
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 3
#: Tokens up to which a wrapper takes up new parts.
WRAPPER_LEAVES = 1500
#: Longest repeated part that folds, in items; items that are aligned at a time, in longer streams between anchors.
LONGEST_UNIT, PIECE = 12, 2000
BROADCAST_BYTES = 32 << 20
#: Pages that one salt of a host takes, where wrappers are not broadcast; matched streams and wrappers that a task remembers.
SALT_PAGES, REMEMBERED = 10_000, 5_000

# Elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object option select svg template".split())
OPTIONS = ("option", "optgroup", "select")
RAW = frozenset("script style title textarea noscript template iframe svg math".split())
# Words in class, id or role that mark what is not the article; those that also mark running text; and those that go with them.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus respond consent cookie cookies gdpr notice notices alert disclaimer footer masthead menu navbar nav navigation newsletter signup subscribe pagination pager popup modal overlay promo promotion related recommended sidebar side share sharing social sponsor sponsored toolbar widget widgets contentinfo complementary search login skip".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies gdpr consent newsletter".split())
FRAME = frozenset("area article articles bar block body box btn button buttons center column container content group head header icon icons inline inner item items left link links list main media page panel post posts right row section site slot small story stories sub top bottom unit wrap wrapper the to us js".split())
# Last parts that name boilerplate whatever stands before them, and first parts that turn this round.
HEADS = frozenset("ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup sidebar toolbar widget widgets".split())
TURNS = frozenset("has have hide hidden is no non not show toggle with without".split())
# Elements of running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dt dd td th caption figcaption a abbr b cite code del em font i ins kbd mark q s small span strong sub sup time u".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>"
    r"|</?[a-zA-Z].*",
    re.S,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_HINT = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++))""", re.I)


_CAMEL = re.compile(r"([a-z])([A-Z])")


def hint_words(name: str, attrs: str) -> list[str]:
    """Words of an element's class, id and role that mark it as boilerplate."""
    found: set[str] = set()
    for m in _HINT.finditer(attrs):
        for word in _CAMEL.sub(r"\1-\2", m[1] or m[2] or m[3] or "").lower().split():
            listed = [x for x in re.split(r"[^a-z]+", word) if x]
            parts = set(listed)
            if not parts <= HINTS | FRAME:
                parts = {listed[-1]} & HEADS if listed[0] not in TURNS else set()
            found |= parts & (ADVERTS if name in RUNNING else HINTS)
    return sorted(found)


class Page:
    """Events of a page: (token, text, state); text is None for tags. A state is (level, boilerplate, in link): level 2 in an
    article, 1 in a main part; boilerplate 2 by an element's name, 1 by words."""

    def __init__(self, html: str):
        self.events: list[tuple[str, str | None, tuple[int, int, bool]]] = []
        self._stack: list[tuple[str, tuple[int, int, bool]]] = []  # open elements with the state inside them
        self._open: dict[str, list[int]] = {}  # where each name is open
        self._blocks: list[int] = []  # where block-level elements are open
        self._state: tuple[int, int, bool] = (0, 0, False)
        at, end = 0, len(html)
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m["name"] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            name = m["name"].lower()
            if m["close"]:
                self._close(name)
                continue
            attrs = m["attrs"]
            if name in RAW:
                if not attrs.endswith("/"):
                    at = found.end() if (found := _ENDS[name].search(html, at)) else end
                continue
            if name in BLOCK and name not in ("html", "body"):  # a block ends an open paragraph; an item ends an item
                self._implied(name)
            elif name in OPTIONS:
                self._implied_option(name)
            hint = hint_words(name, attrs) if attrs else []
            token = name + "".join("." + h for h in hint)
            self.events.append((f"<{token}>", None, self._state))
            if name not in VOID and not attrs.endswith("/"):
                self._push(name, bool(hint) and name not in ("html", "body"))
        if at < end:
            self._text(html[at:])

    def _push(self, name: str, hint: bool) -> None:
        """An article or main part starts anew inside what only words mark, not inside boilerplate elements or those of an article."""
        level, boiler, link = self._state
        if hint:
            boiler = max(boiler, 1)
        elif name in ("article", "main"):
            if boiler < 2 and not (boiler and level == 2):
                level, boiler = max(level, 2 if name == "article" else 1), 0
        elif name in BOILER or name == "header" and not level:
            boiler = 2
        self._open.setdefault(name, []).append(len(self._stack))
        if name in BLOCK:
            self._blocks.append(len(self._stack))
        self._state = (level, boiler, link or name == "a")
        self._stack.append((name, self._state))

    def _pop(self, at: int) -> None:
        """Ends the element at that place and all inside it."""
        while len(self._stack) > at:
            name, _ = self._stack.pop()
            self._open[name].pop()
            if name in BLOCK:
                self._blocks.pop()
        self._state = self._stack[-1][1] if self._stack else (0, 0, False)

    def _close(self, name: str) -> None:
        self.events.append((f"</{name}>", None, self._state))
        if self._open.get(name):
            self._pop(self._open[name][-1])

    def _implied(self, name: str) -> None:
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ()) + ("p",)
        if self._blocks and self._stack[self._blocks[-1]][0] in ends:
            self._pop(self._blocks[-1])

    def _implied_option(self, name: str) -> None:
        """An option, group or list ends those of its kind and below, but no block-level element around them."""
        ends = OPTIONS[: OPTIONS.index(name) + 1]
        least = max(self._open[x][-1] if self._open.get(x) else -1 for x in OPTIONS[len(ends) :]) if len(ends) < len(OPTIONS) else -1
        least = max(least, self._blocks[-1] if self._blocks else -1)
        at = [self._open[x][-1] for x in ends if self._open.get(x) and self._open[x][-1] > least]
        if at:
            self._pop(min(at))

    def _text(self, raw: str) -> None:
        self.events.append(("#", raw, self._state))

    def stream(self) -> list[tuple[str, int | None, int]]:
        """Tokens for alignment with the places of their events; texts outside articles and main parts come with their hash. Kinds of text: b
        boilerplate, a article, n main part, l link, s no letter or digit, m else."""
        out: list[tuple[str, int | None, int]] = []
        for i, (token, text, (level, boiler, link)) in enumerate(self.events):
            if text is None:
                out.append((token, None, i))
            elif text.strip():
                kind = "b" if boiler else "mna"[level] if level else "l" if link else "m" if any(map(str.isalnum, text)) else "s"
                out.append(("#" + kind, None if kind in "na" else text_hash(" ".join(unescape(text).split())), i))
        return out

    def fingerprint(self) -> int:
        """Of all its texts, in order."""
        return text_hash("\0".join(" ".join(text.split()) for _, text, _ in self.events if text and text.strip()))

    def letters(self, kept: list[int]) -> int:
        """Characters of these events' texts but white space."""
        return sum(len("".join(self.events[i][1].split())) for i in kept)

    def blocks(self, kept: set[int]) -> list[str]:
        """The texts of these events, block by block."""
        out: list[str] = []
        part: list[str] = []

        def flush() -> None:
            if part:
                if text := " ".join(unescape("".join(part)).split()):
                    out.append(text)
                part.clear()

        for i, (token, text, _) in enumerate(self.events):
            if text is None:
                name = token.strip("</>").partition(".")[0]
                if name in BLOCK:
                    flush()
                elif name == "br":
                    part.append(" ")
            elif i in kept or part and not text.strip():
                part.append(text)
            elif text.strip():
                flush()
        flush()
        return out


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


# A wrapper is a list of items (kind, body, optional): kind "t" a token, kind "+" a repeated group of items. Of a group, optional is a number: 1 if it is,
# and the group's kinds of text (`kinds`) that its body does not hold, times 2.


def fold_with_places(tokens: list[str], at: list[int] | None = None) -> tuple[list, list]:
    """Runs of equal parts, shortest parts first, become repeated groups; repeated until nothing folds. Also the places
    of the tokens, in the same shape: those of a group are a list of its repetitions."""
    items: list = [("t", t, False) for t in tokens]
    places: list = list(range(len(tokens)) if at is None else at)
    changed = True
    while changed:
        changed = False
        for unit in range(1, LONGEST_UNIT + 1):
            i, out, out_places = 0, [], []
            while i < len(items):
                if items[i] == items[i + unit] if i + unit < len(items) else False:
                    part = items[i : i + unit]
                    k = i + unit
                    while items[k : k + unit] == part:
                        k += unit
                    if k > i + unit:
                        if unit == 1 and part[0][0] == "+":
                            out.append(part[0])
                            out_places.append([repeat for place in places[i:k] for repeat in place])
                        else:
                            out.append(("+", tuple(part), False))
                            out_places.append([places[j : j + unit] for j in range(i, k, unit)])
                        i, changed = k, True
                        continue
                out.append(items[i])
                out_places.append(places[i])
                i += 1
            items, places = out, out_places
    return items, places


def fold(tokens: list[str]) -> list:
    return fold_with_places(tokens)[0]


def key(item) -> tuple:
    """Items with equal keys can merge: the same token, or groups that begin alike."""
    return ("t", item[1]) if item[0] == "t" else ("+", key(item[1][0]))


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items that both hold exactly once, the longest run in the order of both."""
    once_a, once_b = ({x: i for i, x in enumerate(y) if n[x] == 1} for y, n in ((a, Counter(a)), (b, Counter(b))))
    tails: list[int] = []  # smallest last place in b of runs of each length
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []  # (place in a, place in b, one before)
    for x, i in once_a.items():
        if (j := once_b.get(x)) is not None:
            k = bisect_left(tails, j)
            tails[k : k + 1], ends[k : k + 1] = [j], [len(chain)]
            chain.append((i, j, ends[k - 1] if k else -1))
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def parts(a: list, b: list) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of both lists, in order and without gaps, of at most PIECE items each: cut at anchors, else evenly."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        longest = max(i2 - i1, j2 - j1)
        if longest <= PIECE:
            yield i1, i2, j1, j2
            continue
        if found := anchors(a[i1:i2], b[j1:j2]):
            cuts = [(i1, j1)]
            for i, j in found:
                cuts += [(i1 + i, j1 + j), (i1 + i + 1, j1 + j + 1)]
            cuts.append((i2, j2))
        else:
            n = -(-longest // PIECE)
            cuts = [(i1 + (i2 - i1) * k // n, j1 + (j2 - j1) * k // n) for k in range(n + 1)]
        todo += [(p, q, r, s) for (p, r), (q, s) in zip(cuts, cuts[1:]) if p < q or r < s][::-1]


def opcodes(a: list, b: list) -> Iterator[tuple[str, int, int, int, int]]:
    for i1, i2, j1, j2 in parts(a, b):
        if a[i1:i2] == b[j1:j2]:
            yield "equal", i1, i2, j1, j2
            continue
        for op, p, q, r, s in SequenceMatcher(None, a[i1:i2], b[j1:j2], autojunk=False).get_opcodes():
            yield op, i1 + p, i1 + q, j1 + r, j1 + s


def merge(a, b, grow: bool = True) -> list:
    """Align two wrappers: common items stay, the others become optional. No item is lost, unless `grow` is off: then b's own items are not taken up, but the
    groups that both have note what texts there are."""
    out: list = []
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    for op, i1, i2, j1, j2 in opcodes(ka, kb):
        if op == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2]):
                if x[0] == "t":
                    out.append((x[0], x[1], x[2] or y[2]))
                else:
                    out.append((x[0], tuple(merge(x[1], y[1], grow)), x[2] | y[2] | (0 if grow else kinds(y) << 1)))
        else:
            out += [(x[0], x[1], x[2] | 1) for x in (*a[i1:i2], *(b[j1:j2] if grow else ()))]
    return out


def render(items) -> str:
    """The wrapper as a regular expression over tokens."""
    parts = []
    for kind, body, optional in items:
        text = body if kind == "t" else f"({render(body)})+"
        parts.append(f"({text})?" if optional & 1 else text)
    return " ".join(parts)


def constants_of(items) -> set[int]:
    out: set[int] = set()
    for kind, body, _ in items:
        if kind == "+":
            out |= constants_of(body)
        elif body.startswith("="):
            out.add(int(body[1:]))
    return out


def leaves(items) -> Iterator[str]:
    for kind, body, _ in items:
        if kind == "+":
            yield from leaves(body)
        else:
            yield body


def kinds(group) -> int:
    """What texts a group has: 1 links, 2 others."""
    found = {t for t in leaves(group[1]) if t.startswith("#")}
    return group[2] >> 1 | ("#l" in found) | (0 if found.isdisjoint(("#m", "#n", "#a")) else 2)


def is_menu(group) -> bool:
    """A repeated group with links and no other text."""
    return kinds(group) == 1


def alike(place: int, items, i: int) -> int:
    """The place of the group that is item i: equal for groups that begin alike after two equal items, inside groups whose places are equal."""
    return text_hash(repr((place, [key(x) for x in items[max(0, i - 2) : i]], key(items[i]))))


def groups(items, place: int = 0) -> Iterator[tuple[int, int]]:
    """Place and kinds of text of each group."""
    for i, x in enumerate(items):
        if x[0] == "+":
            at = alike(place, items, i)
            yield at, kinds(x)
            yield from groups(x[1], at)


def level_of(token: str, menu: bool) -> int:
    """What a slot holds: 2 article, 1 main part, 0 other main text, -1 none."""
    if token in ("#l", "#s"):
        return -1 if menu else 0
    return {"#a": 2, "#n": 1, "#m": 0}.get(token, -1)


def match(items, wrapper, menu: bool = False, menus: dict[int, bool] | None = None, place: int = 0) -> list:
    """The level of each token of a page's items by the wrapper's slots, in the shape of the items; groups that are not matched
    are judged by `menus` at their places, and where it has none by themselves."""
    own = [level_of(x[1], menu) if x[0] == "t" else None for x in items]
    for op, i1, i2, j1, _ in opcodes([key(x) for x in items], [key(x) for x in wrapper]) if wrapper else ():
        if op == "equal":
            for i in range(i1, i2):
                if items[i][0] == "+":
                    group = wrapper[j1 + i - i1]
                    own[i] = match(items[i][1], group[1], menu or is_menu(group), menus, alike(place, items, i) if menus else 0)
    for i, x in enumerate(items):
        if own[i] is None:
            at = alike(place, items, i) if menus else 0
            own[i] = match(x[1], (), menu or (menus or {}).get(at, is_menu(x)), menus, at)
    return own


def spread(levels: list, places: list, out: dict[int, int]) -> None:
    """Levels by place."""
    for level, place in zip(levels, places):
        if isinstance(place, int):
            out[place] = level
        else:
            for repeat in place:
                spread(level, repeat, out)


def _dump(items) -> str:
    return json.dumps(items, separators=(",", ":"))


def _load(text: str):
    def item(x):
        return (x[0], x[1] if x[0] == "t" else tuple(map(item, x[1])), x[2])

    return [item(x) for x in json.loads(text)]


def host_of(url: bytes | None) -> str:
    return canonical(url or b"")[0].decode()


def _html(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, wrapper, constants, menus): the wrapper of each host as JSON, the hashes of its constant texts, and for places of groups whether they are menus, where
    some group there would be judged otherwise by itself."""
    own = pages.select(url_col, html_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"host": [], "page": [], "hashes": []}
            for url, html in zip(utf8(batch.column(0)), utf8(batch.column(1))):
                page = Page(_html(html))
                out["host"].append(host_of(url))
                out["page"].append(page.fingerprint())
                out["hashes"].append([-1, *sorted({h for _, h, _ in page.stream() if h is not None})])
            yield out

    # of pages with equal texts one counts; their marks may differ, so the least list stands for them
    distinct = arrow_map(own, texts, "host string, page bigint, hashes array<bigint>").groupBy("host", "page").agg(F.min("hashes").alias("hashes"))
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(f"n >= {CONSTANT_PAGES} or hash = -1")
    counts = materialise(counts)
    total = counts.where("hash = -1").select("host", F.col("n").alias("pages"))
    constant = counts.where("hash <> -1").join(total, "host").where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    constant = materialise(constant.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("constants")))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"host": batch.column(2), "wrapper": [], "page": []}
            for html, own_constants in zip(utf8(batch.column(1)), batch.column(3).to_pylist()):
                known, page = set(own_constants or ()), Page(_html(html))
                tokens = [f"={h}" if h in known else t for t, h, _ in page.stream()]
                out["wrapper"].append(_dump(fold(tokens)))
                out["page"].append(page.fingerprint())
            yield out

    with_host = _with_constants(own, constant, url_col)
    level = arrow_map(with_host, streams, "host string, wrapper string, page bigint").groupBy("host", "wrapper").agg(F.count_distinct("page").alias("n"))
    level = materialise(level)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"host": [], "at": [], "kinds": []}
            for host, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(set(groups(_load(items))))
                out["host"] += [host] * len(found)
                out["at"] += [at for at, _ in found]
                out["kinds"] += [k for _, k in found]
            yield out

    found = arrow_map(level.select("host", "wrapper"), judged, "host string, at bigint, kinds int").groupBy("host", "at").agg(F.bit_or("kinds").alias("all"), F.max(F.col("kinds") == 1).alias("some"), F.min("kinds").alias("least"))
    mixed = found.select("host", "at", (F.col("all") == 1).alias("menu")).where(F.when(F.col("all") == 1, F.col("least") == 0).otherwise(F.col("some")))
    menus = materialise(mixed.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("at", "menu"))).alias("menus")))

    def align(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "wrapper"], ascending=[False, True])
        loaded = [_load(w) for w in part["wrapper"]]
        merged = loaded[0]
        for other in loaded[1:]:
            merged = merge(merged, other, sum(1 for x in (merged, other) for _ in leaves(x)) <= WRAPPER_LEAVES)
        return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [_dump(merged)], "n": [int(part["n"].sum())]})

    ship(level)
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("k"))
        if not (sizes.agg(F.max("k")).first()[0] or 0) > 1:
            break
        many = level.join(sizes.where("k > 1"), "host")
        bins = many.withColumn("bin", F.pmod(F.xxhash64("wrapper"), F.greatest(F.lit(1), F.ceil(F.col("k") * 2 / FAN_IN).cast("bigint"))))
        merged = bins.select("host", "bin", "wrapper", "n").groupBy("host", "bin").applyInPandas(align, "host string, wrapper string, n bigint")
        level = materialise(level.join(sizes.where("k = 1").select("host"), "host", "left_semi").unionByName(merged))
    return level.join(constant, "host", "left").join(menus, "host", "left").select("host", "wrapper", "constants", "menus")


def _host(url_col: str) -> Column:
    rest = F.when(F.instr(F.coalesce(url_col, F.lit("")), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _with_constants(own: DataFrame, table: DataFrame, url_col: str) -> DataFrame:
    """The pages (url, html) with their host and its constants, which are broadcast if small."""
    size = table.agg(F.sum(F.octet_length("host") + F.size("constants") * 8 + 40)).first()[0] or 0
    side = table.select(F.col("host").alias("of_host"), "constants")
    named = own.withColumn("page_host", _host(url_col))
    joined = named.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col("page_host") == F.col("of_host"), "left")
    return joined.select(*[named[c] for c in own.columns], "page_host", "constants")


def main_places(page: Page, levels: dict[int, int]) -> set[int]:
    """Places of the best level; with those of articles also those of the main part if these have more text."""
    best = max(levels.values(), default=-1)
    if best < 0:
        return set()
    own = [[i for i, level in levels.items() if level == k] for k in (1, 2)]
    least = 1 if best == 2 and page.letters(own[0]) > page.letters(own[1]) else best
    return {i for i, level in levels.items() if level >= least}


class Matcher:
    """Texts of pages by their hosts' wrappers, with what a task has loaded and matched before."""

    def __init__(self) -> None:
        self._wrappers: dict[str, tuple[list, set[int], dict[int, bool]]] = {}
        self._known: dict[tuple, list] = {}

    def blocks(self, html: str, host: str, wrapper: str) -> list[str]:
        if host not in self._wrappers:
            if len(self._wrappers) >= REMEMBERED:
                self._wrappers.clear()
            given = json.loads(wrapper)
            self._wrappers[host] = _load(given["wrapper"]), set(given.get("constants", ())), {int(at): menu for at, menu in given.get("menus", {}).items()}
        items, constants, menus = self._wrappers[host]
        page = Page(html)
        stream = page.stream()
        own, places = fold_with_places([f"={h}" if h in constants else t for t, h, _ in stream], [i for _, _, i in stream])
        known = (host, xxhash.xxh3_128_intdigest(_dump(own)))
        if known not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[known] = match(own, items, menus=menus)
        levels: dict[int, int] = {}
        spread(self._known[known], places, levels)
        if max(levels.values(), default=-1) < 0:  # all of it is constant or boilerplate: constants count as what they are on the page
            own, places = fold_with_places([t for t, _, _ in stream], [i for _, _, i in stream])
            spread(match(own, own), places, levels)
        return page.blocks(main_places(page, levels))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns: id_col, url_col, text, n_chars, n_blocks."""
    spark = pages.sparkSession
    wrappers = materialise(infer_wrappers(pages, url_col, html_col).select("host", F.to_json(F.struct("wrapper", "constants", "menus")).alias("wrapper")))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    own = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host"))
    small = None
    if size <= BROADCAST_BYTES:
        small = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        rows = own.select("*", F.lit(1).alias("kind"))
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salts = own.groupBy("host").agg(F.ceil(F.count("*") / SALT_PAGES).cast("int").alias("salts"))
        salts = materialise(salts)
        given = wrappers.join(salts, "host").select(
            F.lit(None).cast(pages.schema[id_col].dataType).alias(id_col), F.lit(None).cast("string").alias(url_col), F.col("wrapper").alias("html"), "host", F.lit(0).alias("kind"),
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        )
        salted = own.join(salts, "host").select(id_col, url_col, "html", "host", F.lit(1).alias("kind"), F.pmod(F.xxhash64(id_col, "html"), F.col("salts")).cast("int").alias("salt"))
        rows = given.unionByName(salted).repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "kind").drop("salt")
    id_type = pages.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        matcher, wrapper = Matcher(), ""
        for batch in batches:
            out: dict = {"at": [], "text": [], "n_chars": [], "n_blocks": []}
            for i, (html, host, kind) in enumerate(zip(utf8(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if kind == 0:
                    wrapper = html.decode()
                    continue
                found = matcher.blocks(_html(html), host, wrapper if small is None else small.value[host])
                text = "\n".join(found)
                out["at"].append(i)
                out["text"].append(text)
                out["n_chars"].append(len(text))
                out["n_blocks"].append(len(found))
            kept = batch.take(pa.array(out.pop("at"), pa.int64()))
            yield {id_col: kept.column(0), url_col: kept.column(1)} | out

    return arrow_map(rows, step, f"{id_col} {id_type}, {url_col} string, text string, n_chars bigint, n_blocks bigint")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
