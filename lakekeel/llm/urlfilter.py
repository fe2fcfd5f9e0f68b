"""Operator 8: URL filters by a bit-parallel wildcard automaton.

Method. Glob rules (`*` any run without a slash, `**` any run) become chains of positions that are packed
one after another into 64-bit words. All patterns run at once over each canonical URL by Shift-And steps:
shifted states survive where the rule's byte agrees, waiting states survive under their wildcard. The URLs
of a batch step together, as rows of a numpy matrix of state words.

Canonical URL: "." + host + path. The host is what follows the first `://` up to `/`, `?`, `#` or the end,
A-Z lower-cased; the path follows up to `?`, `#` or the end. The dot in front lets `*.org/**` match the host
`org` and its subdomains alike.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no host rule and gets the
verdict of the globs (allow unless one matches); any length; an empty table gives an empty result; other
columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, utf8

# The contract's rules (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Globs that block where no rule fits.
BLOCK_GLOBS = (
    "**spam-farm**", "**cheap-pills**", "**free-bets**", "**casino**", "**viagra**", "**poker**", "**payday-loan**", "**replica-watch**",
    "*.ads.*", "*.ads.*/**", "*.adserver.*", "*.adserver.*/**", "**/wp-login.php", "**/trackback/**", "**/cgi-bin/**",
)


def canonical(url: bytes) -> tuple[bytes, bytes]:
    """Host and path."""
    at = url.find(b"://")
    if at < 0:
        return b"", b""
    rest = url[at + 3 :]
    for mark in (b"?", b"#"):
        rest = rest.partition(mark)[0]
    slash = rest.find(b"/")
    host, path = (rest, b"") if slash < 0 else (rest[:slash], rest[slash:])
    return host.lower(), path


class GlobAutomaton:
    """All globs over many byte strings at once."""

    def __init__(self, globs: list[str]):
        chains = []
        for glob in globs:
            literals, loops = [], [0]
            text, i = glob.encode(), 0
            while i < len(text):
                if text[i : i + 2] == b"**":
                    loops[-1], i = 2, i + 2
                elif text[i : i + 1] == b"*":
                    loops[-1], i = max(loops[-1], 1), i + 1
                else:
                    literals.append(text[i])
                    loops.append(0)
                    i += 1
            chains.append((literals, loops))
        size = sum(len(loops) for _, loops in chains)
        self.words = max(1, -(-size // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = []
        at = 0
        for literals, loops in chains:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for k, loop in enumerate(loops):
                word, bit = (at + k) // 64, np.uint64(1 << (at + k) % 64)
                if loop:
                    self.stay[:, word] |= bit
                if loop == 1:
                    self.stay[ord("/"), word] &= ~bit
                if k:
                    self.step[literals[k - 1], word] |= bit
            at += len(loops)
            self.ends.append(at - 1)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        starts = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
        flat = np.frombuffer(b"".join(texts[i] for i in order.tolist()), np.uint8)
        falling = -lengths[order]
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -t, side="left"))  # texts longer than t
            chars = flat[starts[:live] + t]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.step[chars] | now & self.stay[chars]
        found = np.empty((len(texts), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            found[order, k] = state[:, end // 64] >> np.uint64(end % 64) & np.uint64(1)
        return found


def url_verdicts(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns: id_col, host, path, rule (the longest fitting one or null), verdict, n_globs (blocking globs that match)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    names = [host + path for _, host, path in rules]
    by_length = sorted(range(len(rules)), key=lambda i: -len(names[i]))
    globs = [f"*.{rules[i][1]}{rules[i][2]}**" for i in by_length] + list(block_globs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        automaton = GlobAutomaton(globs)
        for batch in batches:
            parts = [canonical(u or b"") for u in utf8(batch.column(1))]
            found = automaton.matches([b"." + h + p for h, p in parts])
            out: dict = {id_col: batch.column(0), "host": [h.decode() for h, _ in parts], "path": [p.decode() for _, p in parts], "rule": [], "verdict": [], "n_globs": []}
            n_globs = found[:, len(rules) :].sum(axis=1).tolist()
            first = np.where(found[:, : len(rules)].any(axis=1), found[:, : len(rules)].argmax(axis=1), -1).tolist()
            for k, blocked in zip(first, n_globs):
                out["rule"].append(names[by_length[k]] if k >= 0 else None)
                out["verdict"].append(rules[by_length[k]][0] if k >= 0 else "block" if blocked else "allow")
                out["n_globs"].append(blocked)
            yield out

    return arrow_map(pages.select(id_col, url_col), step, f"{id_col} {id_type}, host string, path string, rule string, verdict string, n_globs bigint")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _glob_sql(glob: str) -> str:
    quoted = glob.replace(".", "[.]").replace("**", "\0").replace("*", "[^/]*").replace("\0", "(.|\n)*")
    return f"case when regexp_full_match(canon, '{quoted}') then 1 else 0 end"


ORACLE = f"""
with cut as (
  select page_id, url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
canon as (select *, '.' || host || path as canon from parts),
rules(verdict, rule_host, rule_path) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
best as (
  select page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id, host, path),
globs as (select page_id, host, path, cast({" + ".join(map(_glob_sql, BLOCK_GLOBS))} as bigint) as n_globs from canon)
select g.page_id, g.host, g.path, b.rule, coalesce(b.verdict, case when g.n_globs > 0 then 'block' else 'allow' end) as verdict, g.n_globs
from globs g left join best b on g.page_id = b.page_id and g.host = b.host and g.path = b.path
"""
