"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words; the automaton holds every window of ``window`` words of the benchmark items (a
shorter item is one window) and reads each document once. A word is a code of three characters, the first from another range
than the rest, so the automaton has at most 30 nodes a window of ten words, whatever the words' lengths, and no match begins
inside a word. Matches are mapped through the word index to byte offsets of the original text.

The benchmark is the small side by its nature, and its size is bounded: distinct windows are dealt into blocks of about
``block_windows``; one block is one automaton and one pass, and more blocks are more passes whose hits are merged per
document. Each executor process builds a block's automaton once and holds one at a time.

Cases: a null or empty text has no words; items without words are never hit; windows of items with a null id mark words and
contaminate, but give no id; repeated items count once by id; repeated documents give a row each (with more than one
block, rows are numbered in a written copy, and blocks' hits are merged by that number); an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import materialize

WINDOW = 10
#: Windows of one automaton: with ten words each some 6 million nodes, about 350 MB in each Python worker.
BLOCK_WINDOWS = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Byte -> itself in lower case if it belongs to a word, else a blank.
_CLEAN = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def _code(k: int) -> str:
    """Three characters of word number k: the first below 128, the others above."""
    return chr(k >> 14) + chr(128 + (k >> 7 & 127)) + chr(128 + (k & 127))


class Matcher:
    """The automaton of a block of windows (words joined by blanks, ids of their items) and its words' codes."""

    def __init__(self, block: list[tuple[str, list[str]]]):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        self.auto = ahocorasick.Automaton()
        for window, ids in block:
            ws = window.encode("utf-8", "surrogatepass").split(b" ")
            for w in ws:
                if w not in self.codes:
                    self.codes[w] = _code(len(self.codes) + 1)  # 0: a word of no window
            self.auto.add_word("".join(map(self.codes.__getitem__, ws)), (len(ws), tuple(ids)))
        if len(self.auto):
            self.auto.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, hit runs of words (first, end), ids of the items hit."""
        ws = words(text)
        if not ws or not len(self.auto):
            return len(ws), [], set()
        get, none = self.codes.get, _code(0)
        found, ids = [], set()
        for end, (n, items) in self.auto.iter("".join([get(w, none) for w in ws])):
            last = end // 3 + 1
            found.append((last - n, last))
            ids.update(items)
        runs: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], b))
            else:
                runs.append((a, b))
        return len(ws), runs, ids


def offsets(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text (UTF-8) of runs of words."""
    if not runs:
        return []
    clean = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_CLEAN), np.uint8)
    word = np.concatenate([[False], clean != 32, [False]])
    edges = np.diff(word.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def windows(benchmark: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """window (its words joined by blanks), ids of its items (strings, sorted) of each distinct window of the benchmark."""
    low = F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _UPPER.lower())
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    rows = items.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window"))
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _blocks(found: DataFrame, block_windows: int) -> list[DataFrame]:
    """The windows (a written table) in blocks of about block_windows, by a hash."""
    n = max(1, -(-found.count() // block_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(n))
    return [found] if n == 1 else [found.where(part == k) for k in range(n)]


_PROCESS: dict = {}


def _matcher(token: str, block) -> Matcher:
    """This process's automaton; the one of another block is dropped."""
    if token not in _PROCESS:
        _PROCESS.clear()
        _PROCESS[token] = Matcher(block.value)
    return _PROCESS[token]


def _scan_block(docs: DataFrame, key: list[str], text: str, block: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["ids"]) for r in block.collect()])
    token = uuid.uuid4().hex
    rows = docs.select(*(F.col(f"`{c}`") for c in key), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(token, shared)
        kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = [(n, runs, offsets(t, runs), sorted(ids)) for t in b.column(len(key)).to_pylist() for n, runs, ids in [matcher.scan(t)]]
                cols = [*b.columns[: len(key)], *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(cols, names=[*key, "n_words", "runs", "spans", "items"])

    pairs = ArrayType(ArrayType(LongType()))
    added = [("n_words", LongType()), ("runs", pairs), ("spans", pairs), ("items", ArrayType(StringType()))]
    schema = StructType([*(rows.schema[c] for c in key), *(StructField(*a) for a in added)])
    return rows.mapInArrow(run, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc id (or the columns in keep), n_words, n_hit, n_items, items (sorted), spans (byte ranges), items_sha256, contaminated of each document."""
    keys = keep or [doc_id]
    blocks = _blocks(materialize(windows(benchmark, item_id, item_text, window), "windows"), block_windows)
    if len(blocks) == 1:
        rows = _scan_block(docs, keys, text, blocks[0])
        runs, items, spans = F.col("runs"), F.col("items"), F.col("spans")
    else:
        keyed = materialize(docs.withColumn("__nth", F.monotonically_increasing_id()), "numbered")
        rows = None
        for block in blocks:  # one at a time is fetched, scanned and written
            one = materialize(_scan_block(keyed, ["__nth"], text, block), "scanned")
            rows = one if rows is None else rows.unionByName(one)
        rows = rows.groupBy("__nth").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        rows = keyed.select(*(F.col(f"`{c}`") for c in keys), "__nth").join(rows, "__nth")
        runs, items, spans = F.array_sort("runs"), F.col("items"), F.array_sort("spans")
    # runs are sorted by their start; what a run adds begins where all runs before it end
    n_hit = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], a["end"]))).alias("n"), F.greatest(a["end"], r[1]).alias("end")
        ),
        lambda a: a["n"],
    )
    return rows.select(
        *(F.col(f"`{c}`") for c in keys),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(runs) > 0).alias("contaminated"),
        items.alias("items"),
        spans.alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; result names that docs has are renamed before, so they can't clash."""
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    back = {v: k for k, v in plain.items()}
    names = {k: plain[options.pop(k, default)] for k, default in (("doc_id", "doc_id"), ("text", "text"))}
    rows = contamination(docs.toDF(*plain.values()), benchmark, keep=list(plain.values()), **names, **options)
    return rows.where(~F.col("contaminated")).select(*(F.col(c).alias(back[c]) for c in plain.values()))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""
