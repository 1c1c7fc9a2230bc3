"""URL filters by a bit-parallel wildcard automaton.

Glob rules over the canonical URL (``.host/path``, lower-case host) are packed into multiword Shift-And masks:
one bit for each literal byte of each rule, 64 bits to a word. All rules and all URLs of an Arrow batch advance
together, a byte at a time; URLs that have ended leave the batch, and those of more than ``LONG`` bytes run one by one on
integers with the same masks. ``*`` repeats any byte but ``/`` (within a host), ``**`` repeats any byte.

Cases: a null url, or one without ``://``, has empty host and path and is matched by no rule (verdict allow, as for
any unmatched url); ids, repeated rows and further columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with its path.
HOST_RULES: list[tuple[str, str, str]] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Glob, verdict: decide where no host rule fits.
GLOBS: list[tuple[str, str]] = [
    ("*casino**", "block"),
    ("*.cheap-pills.**", "block"),
    ("*.free-bets.**", "block"),
    ("*.spam-farm.**", "block"),
    ("*.ads-track.**", "block"),
    ("**/wp-login.php**", "block"),
]


#: Bytes up to which URLs run side by side, and URLs that do so at once.
LONG, ROWS = 2048, 2048


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  # (256, words) bits whose literal is the byte
    stay: np.ndarray  # (256, words) bits that the byte may repeat
    start: np.ndarray  # (words,) first bits of the rules, entered from the start state
    first_stay: np.ndarray  # (256, words) first bits of rules that may still be entered after the byte
    final: np.ndarray  # (words,) last bits
    bits: np.ndarray  # last bit of each rule


def compile_globs(globs: list[str]) -> Automaton:
    """Masks for rules that must match from the first byte; a rule's end is open only after a closing ``*``/``**``."""
    spans, n = [], 0
    for g in globs:
        raw, i, lead, lits, loops = g.encode(), 0, 0, [], []
        while i < len(raw):
            if raw[i : i + 1] == b"*":
                kind = 2 if raw[i : i + 2] == b"**" else 1
                i += kind
                if lits:
                    loops[-1] = max(loops[-1], kind)
                else:
                    lead = max(lead, kind)
            else:
                lits.append(raw[i])
                loops.append(0)
                i += 1
        if not lits:
            raise ValueError(f"a rule needs a literal: {g!r}")
        spans.append((lead, lits, loops, n))
        n += len(lits)
    words = max(1, -(-n // 64))
    step, stay, first_stay = (np.zeros((256, words), np.uint64) for _ in range(3))
    start, final, bits = np.zeros(words, np.uint64), np.zeros(words, np.uint64), []
    for lead, lits, loops, at in spans:
        for k, (b, loop) in enumerate(zip(lits, loops, strict=True)):
            w, bit = (at + k) // 64, np.uint64(1 << ((at + k) % 64))
            step[b, w] |= bit
            if loop:
                stay[:, w] |= bit
                if loop == 1:
                    stay[ord("/"), w] &= ~bit
        w, bit = at // 64, np.uint64(1 << (at % 64))
        start[w] |= bit
        if lead:
            first_stay[:, w] |= bit
            if lead == 1:
                first_stay[ord("/"), w] &= ~bit
        end = at + len(lits) - 1
        final[end // 64] |= np.uint64(1 << (end % 64))
        bits.append(end)
    return Automaton(step, stay, start, first_stay, final, np.array(bits))


def _run_long(a: Automaton, url: bytes) -> np.ndarray:
    """Rules that match one URL; all words of a mask are one integer."""
    whole = lambda words: sum(int(w) << (64 * k) for k, w in enumerate(words))
    step, stay, again = ([whole(row) for row in masks] for masks in (a.step, a.stay, a.first_stay))
    start = enter = whole(a.start)
    state = 0
    for c in url:
        state = ((state << 1 & ~start) | enter) & step[c] | state & stay[c]
        enter &= again[c]
    return np.array([state >> int(k) & 1 for k in a.bits], bool)


def run(a: Automaton, urls: list[bytes]) -> np.ndarray:
    """(urls, rules) booleans. Rows are run in the order of their lengths, so the live ones are the last."""
    out = np.zeros((len(urls), len(a.bits)), bool)
    lens = np.array([len(u) for u in urls], np.int64)
    order = np.argsort(lens, kind="stable")
    short = order[: int((lens <= LONG).sum())]
    for i in order[len(short) :].tolist():
        out[i] = _run_long(a, urls[i])
    for at in range(0, len(short), ROWS):
        part = short[at : at + ROWS]
        ends = lens[part]
        chars = np.zeros((int(ends[-1]), len(part)), np.uint8)
        for r, i in enumerate(part.tolist()):
            chars[: ends[r], r] = np.frombuffer(urls[i], np.uint8)
        state = np.zeros((len(part), len(a.start)), np.uint64)
        enter = np.tile(a.start, (len(part), 1))
        for j, live in enumerate(np.searchsorted(ends, np.arange(int(ends[-1])), "right").tolist()):
            c, now = chars[j, live:], state[live:]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~a.start  # a rule's first bit isn't reached from the rule packed before it
            state[live:] = ((moved | enter[live:]) & a.step[c]) | (now & a.stay[c])
            enter[live:] &= a.first_stay[c]
        hit = state[:, a.bits // 64] >> (a.bits % 64).astype(np.uint64) & np.uint64(1)
        out[part] = hit.astype(bool)
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.coalesce(path, F.lit(""))


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    globs: list[tuple[str, str]] = GLOBS,
    default: str = "allow",
) -> DataFrame:
    """pages plus host, path, rule (the longest fitting host rule as ``host/path``, else null), glob and verdict.

    Of host rules of equal length the earlier wins; a host rule decides before any glob, of the globs the first.
    Columns of pages that have a result's name are replaced.
    """
    names = [h + p for h, p, _ in host_rules]
    auto = compile_globs([f"*.{h}{p}**" for h, p, _ in host_rules] + [g for g, _ in globs])
    order = sorted(range(len(names)), key=lambda k: (-len(names[k]), k))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "glob", "verdict")]
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = b.column(b.num_columns - 2).to_pylist()
            paths = b.column(b.num_columns - 1).to_pylist()
            hits = run(auto, [f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            rule, glob, verdict = [], [], []
            for row in hits:
                k = next((k for k in order if row[k]), None)
                g = next((g for g in range(len(globs)) if row[len(names) + g]), None)
                rule.append(None if k is None else names[k])
                glob.append(None if g is None else globs[g][0])
                verdict.append(host_rules[k][2] if k is not None else globs[g][1] if g is not None else default)
            cols = [*b.columns, pa.array(rule, pa.string()), pa.array(glob, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "rule", "glob", "verdict"])

    added = [StructField(c, StringType()) for c in ("rule", "glob", "verdict")]
    return rows.mapInArrow(judge, StructType([*rows.schema.fields, *added]))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u),
r(h, pre, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.*, (SELECT max_by(h || pre, length(h || pre)) FROM r
               WHERE ('.' || host) LIKE ('%.' || h) AND starts_with(path, pre)) AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT v FROM r WHERE h || pre = rule)
            WHEN contains(host, 'casino') OR regexp_matches('.' || host, '[.](cheap-pills|free-bets|spam-farm|ads-track)[.]')
                 OR contains(path, '/wp-login.php') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
