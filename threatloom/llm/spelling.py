"""Spelling variant grouping: a frontier of trie states, joined level by level with a distributed edge table.

The vocabulary's words form a trie whose edges are a table (depth, parent, ch, child): a node is the hash of its prefix. The
frontier holds states (word's node, position, node, edits) that have spent their one edit: the node ``q`` of all words with a
common prefix, the node ``t`` reached by the other spelling, and ``gap``, by how much t is deeper (0: a code point was replaced,
1: t has one more). States without an edit are the trie itself, since there q = t; words that share a prefix share a state.
Each level joins the frontier with the edges of q and, on the same code point, with those of t, and adds the states that
spend their edit there: pairs of children of one node, and children's children, found for all levels at once. Replacements are followed from the smaller to
the greater code point and insertions in the longer word alone, an insertion at the end of a run of equal code points; so each
pair of near words comes up once. A state whose two subtrees hold no words of fitting lengths is dropped (a bit mask of
lengths on each edge). States that end in two words are near words; a Levenshtein test guards against equal hashes.

A node has at most as many edges as the alphabet has letters, and a state at most that many successors, so no key is hot
however often a word or a prefix occurs. Each level's frontier is written; there are as many levels as code points in the longest word.

Words beyond ``long_from`` code points would each cost a level a code point: their near words are found by the hashes of the
word with one code point left out (as many as it has code points, computed in one pass), exactly verified. Words of exactly
``long_from`` take part in both searches, so a pair across the border is found.

Cases: a null or empty text has no words; a null id counts as an empty one in the deletion draw; repeated rows count
their words again; very long texts and words are read whole; ties between forms go to the smallest in code-point order; an
empty table, or one without words, gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_LENGTH, MIN_COUNT = 7, 2
#: One in so many (document, word) pairs loses a code point, as the contract of the query has it; None leaves words alone.
DAMAGE = 31
#: A form has at least so many times the word's occurrences.
FORM_RATIO = 10
LONG_FROM = 60
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """word, n: lower-cased runs of letters of at least min_length code points that occur min_count times or more."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(body, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))  # shorter ones give no word
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    if damage is None:
        words = rows.select(F.col("run").alias("word"))
    else:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = rows.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def trie(words: DataFrame) -> DataFrame:
    """depth, parent, ch, child, is_word, lengths (bit mask of the lengths of words below) of each edge, for words of up to 62 code points."""
    at = words.select("word", F.length("word").alias("len"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth"))
    ends = at.select(
        "depth",
        F.xxhash64(F.substring("word", F.lit(1), F.col("depth") - 1)).alias("parent"),
        F.substring("word", F.col("depth"), F.lit(1)).alias("ch"),
        F.xxhash64(F.substring("word", F.lit(1), F.col("depth"))).alias("child"),
        (F.col("depth") == F.col("len")).alias("is_word"),
        F.expr("shiftleft(1L, len)").alias("lengths"),
    )
    return ends.groupBy("depth", "parent", "ch", "child").agg(F.max("is_word").alias("is_word"), F.bit_or("lengths").alias("lengths"))


def _fits(q: str, t: str, gap: Column) -> Column:
    """Both subtrees hold words whose lengths differ by the gap."""
    return F.when(gap == 1, F.shiftleft(q, 1)).otherwise(F.col(q)).bitwiseAND(F.col(t)) != 0


def frontier(edges: DataFrame) -> list[DataFrame]:
    """Written tables of states (q, t, gap, skip, near): those that spend their edit, of all levels, and those that are moved on, one a level;
    edges: a table written by depth.

    skip: the code point just inserted, which q may not go on with; near: both nodes are words. Levels are folders, so the steps of
    all levels are the same two joins to the driver, and it keeps one program for them.
    """
    depths = [r[0] for r in edges.select("depth").distinct().orderBy("depth").collect()]  # at most LONG_FROM
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("depth", "parent", "ch", "child", "is_word", "lengths")))
    state = lambda df, gap, skip: df.where(_fits("q_lengths", "t_lengths", gap)).select(F.col("q_child").alias("q"), F.col("t_child").alias("t"), gap.cast("int").alias("gap"), skip.alias("skip"), (F.col("q_is_word") & F.col("t_is_word")).alias("near"), F.col("q_depth").alias("depth"))
    none = F.lit(None).cast("string")
    q, t = side(edges, "q"), side(edges, "t")
    # an insertion before the first code point
    first = t.where(F.col("t_depth") == 1).select(F.xxhash64(F.lit("")).alias("q"), F.col("t_child").alias("t"), F.lit(1).alias("gap"), F.col("t_ch").alias("skip"), F.lit(False).alias("near"), F.lit(0).alias("depth"))
    replaced = q.join(t, (F.col("q_depth") == F.col("t_depth")) & (F.col("q_parent") == F.col("t_parent"))).where(F.col("q_ch") < F.col("t_ch"))
    inserted = q.join(t, (F.col("q_depth") + 1 == F.col("t_depth")) & (F.col("q_child") == F.col("t_parent")))
    spent = first.unionByName(state(replaced, F.lit(0), none)).unionByName(state(inserted, F.lit(1), F.col("t_ch")))
    spent = materialize(spent.repartitionByRange("depth", "q"), "trie-spent", "depth")
    out = [spent.drop("depth")]
    for d in depths:
        states = spent.where(F.col("depth") == d - 1).drop("depth")
        states = states.unionByName(out[-1]) if len(out) > 1 else states
        moved = states.drop("near").join(q.where(F.col("q_depth") == d), F.col("q") == F.col("q_parent")).where(F.col("skip").isNull() | (F.col("skip") != F.col("q_ch")))
        moved = moved.join(t.where(F.col("t_depth").isin(d, d + 1)), (F.col("t") == F.col("t_parent")) & (F.col("q_ch") == F.col("t_ch")))
        out.append(materialize(state(moved, F.col("gap"), none).drop("depth"), f"trie-{d}"))
    return out


def long_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct words that may be near, by equal hashes of words with one code point left out."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word_id, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                terms = codes * np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, base)]))
                before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
                cuts = np.unique(before[:-1] + (before[-1] - before[1:]) * inverse)
                found = np.concatenate([before[-1:], cuts]).view(np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = pa.array(found[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(word_id, pa.int64()), len(part)), part, pa.array(np.arange(at, at + len(part)) > 0)], names=["id", "key", "cut"])

    keys = words.select(F.xxhash64("word").alias("id"), "word").mapInArrow(run, "id long, key long, cut boolean")
    a, b = keys.toDF("a", "key", "a_cut"), keys.toDF("b", "key", "b_cut")
    # both cut: equal lengths, each pair once; one cut: it is the longer word
    return a.join(b, "key").where(F.col("b_cut") & ((F.col("a_cut") & (F.col("a") < F.col("b"))) | ~F.col("a_cut"))).select("a", "b").distinct()


def near_pairs(words: DataFrame, long_from: int = LONG_FROM) -> DataFrame:
    """Pairs of ids (xxhash64 of the word) a and b, each once, of words (a written table: word, n) one edit apart."""
    edges = trie(words.where(F.length("word") <= long_from))
    edges = materialize(edges.repartitionByRange("depth", "child"), "trie", "depth")  # a level reads its own files
    states = frontier(edges)
    folders = sorted({f.rsplit("/", 1)[0] for s in states[1:] for f in s.inputFiles()})
    near = lambda df: df.where("near").select(F.col("q").alias("a"), F.col("t").alias("b"))
    ends = near(states[0])
    if folders:  # one scan of all levels
        ends = ends.unionByName(near(words.sparkSession.read.schema(states[1].schema).parquet(*folders)))
    pairs = ends.unionByName(long_pairs(words.where(F.length("word") >= long_from)))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from each word by forms (word, form); a form occurs FORM_RATIO times as often, so chains are short."""
    rows = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the way; occurrences grow by the ratio, so at most five rounds
        step = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(rows.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        rows = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return rows


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = FORM_RATIO, long_from: int = LONG_FROM, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary; options: of vocabulary()."""
    words = materialize(vocabulary(docs, doc_id, text, **options), "words")
    keyed = words.select(F.xxhash64("word").alias("id"), "word", "n")
    one = lambda p: keyed.select(*(F.col(c).alias(f"{p}_{c}") for c in keyed.columns))
    pairs = near_pairs(words, long_from).join(one("a"), F.col("a") == F.col("a_id")).join(one("b"), F.col("b") == F.col("b_id"))
    pairs = materialize(pairs.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a_word", "a_n", "b_word", "b_n"), "near")
    both = pairs.toDF("word", "n", "near", "near_n").unionByName(pairs.select(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.n") >= ratio * F.col("n")
    found = materialize(best.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")), "forms")
    roots = follow(found.where(F.col("form").isNotNull()))
    rows = words.join(found, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
