"""Removal of repeated substrings by distributed prefix doubling over sampled suffixes.

A byte is removed if a ``length``-byte string that starts anywhere else as well covers it. Sorting all suffixes would
move some 24 bytes for each byte of text and round, so suffixes are sampled by content: of each ``REACH`` places next to
each other that of the least 16-byte hash is an anchor, so equal strings have equal anchors. A text is then a
sequence of phrases, each from an anchor to the end of the next one's gram (the first from the text's begin).

1. A phrase's first rank is that of its bytes (128-bit hash). In round r Spark groups the pairs (rank of anchor k, rank
   of anchor k + 2^r), drops those that occur once, sorts the rest and numbers them: the ranks of 2^(r+1) phrases.
   After ``ROUNDS`` rounds a rank covers what is determined inside a window. Past a text's end the rank is 0.
2. Windows of ``length`` bytes with the same first and last anchor are a run. Two ranks that overlap name what all
   windows of a run share (its core), two more what they cover together (its whole). A core that occurs once holds no
   repeat. If all runs of a core have one whole, or a whole occurs again, all windows of these runs are repeated.
3. What is left, windows at the ends of repeated stretches, is compared window by window (128-bit hashes), with a member
   of each whole that step 2 has settled.

A text sends each pair, run and window that it holds several times (periodic texts do) once, with its count. Hashes are first
counted by half; the bits of a sketch of bounded size then keep most of those that occur once out of the
exact count by 128 bits. Past some hundred GB the sketch fills up, is not used, and all rows are counted exactly. A group of more than a thousandth of all rows (fewer than a thousand exist) is joined
back by broadcast, the others by a shuffle. Long texts are hashed in chunks.

The first ranks also tell what texts share: ``n_shared`` counts the bytes of phrases in a row that other rows have, if they
make ``passage - 2 * REACH + 2`` bytes (128, some 20 words) or more. Any string of ``passage`` bytes that another row has
holds such phrases, determined by its own bytes; most shorter ones of 51 words do. They are reported, not removed.

Cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated rows repeat each other, but are one
row for ``n_shared``; a row is known by two hashes of its id and text, so repeated or null ids don't mix texts; an
empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, likely, materialize, mix64, sized_broadcast

LENGTH = 400
PASSAGE = 350
REACH = 112
GRAM = 16
#: Doublings: a rank of the last round covers 2^ROUNDS phrases of some 56 bytes, what the windows of a run share; names of more
#: phrases are made of these ranks inside each text.
ROUNDS = 2
#: Places hashed at once.
CHUNK = 1 << 20
BROADCAST_ROWS = 100_000
ROW = ["row", "twin"]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the 16-byte strings from each place."""
    words = np.empty(len(data) - 7, np.uint64)
    for s in range(8):
        words[s::8] = data[s : s + (len(data) - s) // 8 * 8].view("<u8")
    return mix64(words[:-8] * np.uint64(0x9DDFEA08EB382D69) ^ mix64(words[8:]))


def _sliding(data: np.ndarray) -> np.ndarray:
    """Place of the least hash of each stretch of REACH places, the first of equal ones."""
    least = _grams(data)
    least = (least & ~np.uint64(0xFFFFFF)) | np.arange(len(least), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and the first of the stretches of REACH places that each is the anchor of."""
    count = len(data) - REACH - GRAM + 2
    places, firsts = [], []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(count, 0), CHUNK):
        n = min(CHUNK, count - at)
        place = _sliding(whole[at : at + n + REACH + GRAM - 2])[:n] + at
        new = np.flatnonzero(np.diff(place, prepend=places[-1][-1] if places else -1))
        if len(new):
            places.append(place[new])
            firsts.append(new + at)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(firsts)


def phrases(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the phrases of all texts, first stretches of their anchors (-1: a text's begin that is none), phrases of each text."""
    out = []
    for t in texts:
        place, first = anchors(t)
        virtual = not len(place) or place[0] > 0
        out.append((np.concatenate([[0], place]), np.concatenate([[-1], first])) if virtual else (place, first))
    starts, firsts = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return starts, firsts, np.array([len(o[0]) for o in out], np.int64)


def symbols(data: bytes, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of the phrases, as pairs of integers."""
    from xxhash import xxh3_128_digest

    view, ends = memoryview(data), [*(starts[1:] + GRAM).tolist(), len(data)]
    return np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]), np.int64).reshape(-1, 2)


def window_hashes(data: bytes, places: np.ndarray, size: int) -> np.ndarray:
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    return np.frombuffer(b"".join([xxh3_128_digest(view[p : p + size]) for p in places.tolist()]), np.int64).reshape(-1, 2)


def distinct(own: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of columns within each owner (owners ascend): columns, owners, counts, and each row's place among its owner's."""
    order = np.lexsort((*columns[::-1], own))
    cols = [c[order] for c in (own, *columns)]
    new = np.ones(len(own), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols]) if len(own) else new[1:]
    first = np.flatnonzero(new)
    owners = cols[0][first]
    begins = np.searchsorted(owners, owners)
    place = np.empty(len(own), np.int64)
    place[order] = (np.arange(len(first)) - begins)[np.cumsum(new) - 1] if len(own) else 0
    return [c[first] for c in cols[1:]], owners, np.diff(np.append(first, len(own))), place


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values, kind))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n


def _own(n: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(n)), n)


#: gaps: between starts of phrases; leads: from the first stretch of an anchor to it; ranks: those of all rounds so far, phrase by
#: phrase; at: which of the pairs (a, b) that are to be ranked each phrase begins, -1 for none; times: how often the text holds
#: the pair; shared: byte ranges of phrases that other rows have.
STATE = (
    "row long, twin long, id long, w int, size int, gaps array<int>, leads array<int>, ranks array<long>, at array<int>,"
    " a array<long>, b array<long>, times array<int>, shared array<struct<first:int,last:int>>"
)
_PAIRS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _pairs(m: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
    """at, a, b, times of texts of m phrases: the pairs (a, b) where at is 0, made distinct within texts."""
    use, own = at >= 0, _own(m)
    (a, b), owners, times, place = distinct(own[use], [a[use], b[use]])
    at = at.copy()
    at[use] = place
    n = np.bincount(owners, minlength=len(m))
    return {"at": _lists(at, m, pa.int32()), "a": _lists(a, n, pa.int64()), "b": _lists(b, n, pa.int64()), "times": _lists(times, n, pa.int32())}


def _phrases(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """texts (row, twin, text) -> STATE before the first round, a row a distinct row; w: how often it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            datas = [t.encode() for t in b.column(2).to_pylist()]
            starts, firsts, m = phrases(datas)
            ends = np.cumsum(m)
            s = np.concatenate([symbols(d, starts[x:y]) for d, x, y in zip(datas, (ends - m).tolist(), ends.tolist(), strict=True)])
            gaps = np.diff(starts, prepend=0)
            gaps[(ends - m)[m > 0]] = 0
            nil = np.zeros(len(datas), np.int64)
            cols = {"row": b.column(0), "twin": b.column(1), "id": pa.array(nil), "w": pa.array(nil, pa.int32()), "size": pa.array([len(d) for d in datas], pa.int32())}
            cols |= {"gaps": _lists(gaps, m, pa.int32()), "leads": _lists(starts - firsts, m, pa.int32()), "ranks": _lists(nil[:0], nil, pa.int64())}
            cols |= _pairs(m, np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
            yield pa.RecordBatch.from_pydict(cols | {"shared": pa.array([None] * len(datas), _PAIRS)})

    rows = scratch.write(texts.mapInArrow(run, STATE).withColumn("id", F.monotonically_increasing_id()), "phrases")
    twice = rows.groupBy(*ROW).agg(F.count(F.lit(1)).cast("int").alias("times_there"), F.min("id").alias("one")).where("times_there > 1")
    rows = rows.join(sized_broadcast(scratch.write(twice, "twice"), BROADCAST_ROWS), ROW, "left").where("one is null or one = id")
    return rows.withColumn("w", F.coalesce("times_there", F.lit(1))).drop("times_there", "one")


def _likely(rows: DataFrame, key: str) -> DataFrame:
    """rows (..., n) without most of those whose key (half a hash) occurs once."""
    return likely(rows, rows.groupBy(key).agg(F.sum("n").alias("n")).where("n > 1").select(key), key)


def stretches(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, shared: np.ndarray, least: int, texts: int) -> list[list[dict[str, int]]]:
    """Byte ranges, by text, of the phrases in a row that other rows have, of ``least`` bytes or more."""
    at = np.flatnonzero(shared)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (own[at[1:]] != own[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    out: list[list[dict[str, int]]] = [[] for _ in range(texts)]
    for t, a, b in zip(own[first].tolist(), starts[first].tolist(), ends[last].tolist(), strict=True):
        if b - a >= least:
            out[t].append({"first": a, "last": b})
    return out


def _ranked(state: DataFrame, r: int, passage: int, scratch: Scratch) -> DataFrame:
    """Round r: pairs that occur more than once are sorted and numbered from 1; the next pairs are theirs, 2^r phrases apart. The
    first round finds what rows share. Texts without a pair left have no repeat and stop there."""
    pairs = state.select("id", "w", F.posexplode(F.arrays_zip("a", "b", "times")).alias("i", "p")).select("id", "i", "p.a", "p.b", (F.col("p.times") * F.col("w")).alias("n"))
    pairs = scratch.write(_likely(pairs, "a"), "likely") if r == 0 else pairs
    found = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")  # a row has a pair once
    found = found.select("a", "b", "n", (F.col("rows") > 1).alias("shared")).repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    found = scratch.write(found.withColumn("fresh", F.monotonically_increasing_id() + 1), "pairs")
    back = join_groups(pairs.drop("n"), found, ["a", "b"]).groupBy("id").agg(F.collect_list(F.struct("i", "fresh", "shared")).alias("got"))
    carried = [*ROW, "id", "w", "size", "gaps", "leads", "ranks", "at", "shared"]
    own_pairs = F.size("a").alias("n_pairs")
    rows = state.select(*carried, own_pairs).join(back, "id", "left" if r else "inner").select(*carried, "n_pairs", "got")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            (gaps, m), (at, _) = _flat(b.column(5)), _flat(b.column(8))
            own, ends = _own(m), np.cumsum(m)
            n_pairs = b.column(10).to_numpy().astype(np.int64)
            base = np.cumsum(n_pairs) - n_pairs
            fresh, shared = np.full(n_pairs.sum() + 1, -1, np.int64), np.zeros(n_pairs.sum() + 1, bool)
            got, n_got = b.column(11).flatten(), np.diff(b.column(11).offsets.to_numpy())
            place = base[_own(n_got)] + got.field(0).to_numpy()
            fresh[place], shared[place] = got.field(1).to_numpy(), got.field(2).to_numpy(zero_copy_only=False)
            pair = np.where(at >= 0, base[own] + at, -1)  # -1 is the last place, of no pair
            rank = fresh[pair]
            old, _ = _flat(b.column(7))
            ranks = np.concatenate([old.reshape(len(rank), r), rank[:, None]], axis=1).ravel()
            off = 1 << r
            there = np.arange(len(rank)) + off
            after = np.where(there < ends[own], rank[np.minimum(there, len(rank) - 1)] if len(rank) else rank, 0)
            cols = dict(zip([*ROW, "id", "w", "size", "gaps", "leads"], b.columns[:7], strict=True))
            cols |= {"ranks": _lists(ranks, m * (r + 1), pa.int64())} | _pairs(m, np.where((rank >= 0) & (after >= 0), 0, -1), rank, after)
            if r == 0:
                starts = np.cumsum(gaps)
                starts -= np.repeat(starts[ends - m], m)
                after_last = np.append(starts[1:], 0) + GRAM
                after_last[ends - 1] = b.column(4).to_numpy()
                cols["shared"] = pa.array(stretches(own, starts, after_last, shared[pair], passage - 2 * REACH + 2, len(m)), _PAIRS)
            else:
                cols["shared"] = pa.nulls(len(m), _PAIRS)
            yield pa.RecordBatch.from_pydict(cols)

    return scratch.write(rows.mapInArrow(run, STATE), "ranks")


class Ranks:
    """Ranks of a text's phrases: at[r][k] is that of 2^r phrases from k on, as two integers, and whether it is known (not
    unique). Rounds that Spark hasn't done are 128-bit hashes of pairs of ranks."""

    def __init__(self, levels: np.ndarray):
        self.at = [(row, row, row >= 0) for row in levels]

    def _level(self, r: int) -> tuple[np.ndarray, ...]:
        while len(self.at) <= r:
            off = 1 << (len(self.at) - 1)
            *lanes, known = self.at[-1]
            near, far = slice(0, max(0, len(known) - off)), slice(off, None)
            pair = [np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)]
            for lane, new, odd in zip(lanes, pair, (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F), strict=True):
                values = lane.view(np.uint64)
                new[near] = mix64(mix64(values[near] * np.uint64(odd)) + values[far]).view(np.int64)
            both = np.zeros(len(known), bool)
            both[near] = known[near] & known[far]
            self.at.append((*pair, both))
        return self.at[r]

    def named(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the phrases i to j: two integers each, and whether their ranks are known. Two stretches of
        2^r phrases that overlap make the name."""
        a, b, known = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        rounds = np.frexp(j - i)[1] - 1
        for r in np.unique(rounds).tolist():
            at = np.flatnonzero(rounds == r)
            low, high, fine = self._level(r)
            x, y = i[at], j[at] - (1 << r)
            known[at] = fine[x] & fine[y]
            if r <= ROUNDS:
                a[at], b[at] = low[x], low[y]
            else:
                for out, lane in ((a, low), (b, high)):
                    values = lane.view(np.uint64)
                    out[at] = mix64(mix64(values[x] + np.uint64(r)) + values[y]).view(np.int64)
        return a, b, known


CORE, WHOLE = ["ca", "cb", "c"], ["wa", "wb", "wc"]
RUNS = "row long, twin long, id long, w int, first array<int>, last array<int>, cls array<int>, core array<long>, ca array<long>, cb array<long>, c array<long>, wa array<long>, wb array<long>, wc array<long>, times array<int>"


def runs_of(sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, firsts: np.ndarray, m: np.ndarray, ranks: Ranks, length: int) -> list[np.ndarray]:
    """text, first, last, CORE, WHOLE of the runs of windows, in texts of the sizes and of m phrases each, whose core occurs again.

    Texts lie one behind the other, so far apart that no window reaches from one into the next.
    """
    bases = np.cumsum(sizes + 2 * length) - sizes - 2 * length
    own = _own(m)
    begins, real = starts + bases[own], np.flatnonzero(firsts >= 0)
    anchor = firsts[real] + bases[own[real]]
    ahead = length - REACH - GRAM + 1
    cuts = np.unique(np.concatenate([anchor, anchor - ahead, bases + np.maximum(sizes - length + 1, 0)]))
    text = np.searchsorted(bases, cuts, "right") - 1
    ok = (text >= 0) & (cuts - bases[text] <= sizes[text] - length)
    first, last, text = cuts[ok], (np.append(cuts[1:], 0) - 1)[ok], text[ok]
    i = real[np.searchsorted(anchor, first, "right") - 1]
    j = real[np.searchsorted(anchor, first + ahead, "right") - 1]
    ca, cb, ok = ranks.named(i, j)
    first, last, text, i, j, ca, cb = (c[ok] for c in (first, last, text, i, j, ca, cb))
    # phrases around all windows of the run; the last phrase ends with the text
    left = np.searchsorted(begins, first, "right") - 1
    right = np.searchsorted(begins + GRAM, last + length, "left")
    wa, wb, ok = ranks.named(left, right)
    base = bases[text]
    wc = ((right - left) << 24) | ((first - begins[left]) << 12) | (last - first)
    return [text, first - base, last - base, ca, cb, j - i, np.where(ok, wa, ids[text]), np.where(ok, wb, 0), np.where(ok, wc, -1 - (first - base))]


def _runs(state: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """state -> RUNS; cls: which of the distinct runs (core: a hash of CORE; WHOLE, times) each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            (gaps, m), (leads, _), (levels, _) = (_flat(b.column(k)) for k in (5, 6, 7))
            ends = np.cumsum(m)
            starts = np.cumsum(gaps)
            starts -= np.repeat(starts[ends - m], m)
            sizes, ids = b.column(4).to_numpy().astype(np.int64), b.column(2).to_numpy()
            text, first, last, *keys = runs_of(sizes, ids, starts, starts - leads, m, Ranks(np.ascontiguousarray(levels.reshape(-1, ROUNDS + 1).T)), length)
            n = np.bincount(text, minlength=len(m))
            keys, owners, times, cls = distinct(text, keys)
            core = mix64(mix64(mix64(keys[0].view(np.uint64)) + keys[1].view(np.uint64)) + keys[2].view(np.uint64)).view(np.int64)
            own = np.bincount(owners, minlength=len(m))
            cols = [*b.columns[:4], *(_lists(c, n, pa.int32()) for c in (first, last, cls)), *(_lists(c, own, pa.int64()) for c in (core, *keys)), _lists(times, own, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*ROW, "id", "w", "first", "last", "cls", "core", *CORE, *WHOLE, "times"])

    return scratch.write(state.select(*ROW, "id", "w", "size", "gaps", "leads", "ranks").mapInArrow(run, RUNS), "runs")


def _settle(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, done (runs of repeated windows), todo (runs to be compared window by window)."""
    zipped = F.arrays_zip("core", *CORE, *WHOLE, "times")
    kinds = runs.select("id", "w", F.posexplode(zipped).alias("cls", "k")).select("id", "cls", *(f"k.{c}" for c in ("core", *CORE, *WHOLE)), (F.col("k.times") * F.col("w")).alias("n"))
    kinds = scratch.write(_likely(kinds, "core"), "kinds")
    alike = [(F.min(c) == F.max(c)).alias(f"one_{c}") for c in WHOLE]
    cores = kinds.groupBy(*CORE).agg(F.sum("n").alias("n"), *alike).where("n > 1")
    cores = scratch.write(cores.select(*CORE, "n", F.expr("one_wa and one_wb and one_wc").alias("alike")), "cores")
    several = scratch.write(join_groups(kinds.withColumnRenamed("n", "k"), cores, CORE).drop("n", *CORE), "several")
    mixed = several.where("not alike")
    wholes = mixed.groupBy(*WHOLE).agg(F.sum("k").alias("n"), F.min(F.struct("id", "cls")).alias("one"), F.min("core").alias("core")).where("n > 1")
    wholes = scratch.write(wholes, "wholes")
    known = scratch.write(join_groups(mixed.select("id", "cls", "core", *WHOLE), wholes.select(*WHOLE, "n"), WHOLE, "left").select("id", "cls", "core", F.col("n").isNotNull().alias("done")), "known")
    # a core whose runs are all settled needs no member to be compared with
    open_cores = known.where("not done").groupBy(F.col("core").alias("open")).agg(F.count(F.lit(1)).alias("n"))
    members = wholes.select("core", "one").join(open_cores.select("open"), F.col("core") == F.col("open"), "left_semi")
    marks = several.where("alike").select("id", "cls", F.lit(True).alias("done"))
    marks = marks.unionByName(known.select("id", "cls", "done")).unionByName(members.select("one.*", F.lit(False).alias("done")))
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("cls", "done")).alias("marks"))
    rows = runs.select(*ROW, "id", "first", "last", "cls").join(marks, "id").select(*ROW, "id", "first", "last", "cls", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            (first, n), (last, _), (cls, _) = (_flat(b.column(k)) for k in (3, 4, 5))
            own = _own(n)
            marks, n_marks = b.column(6).flatten(), np.diff(b.column(6).offsets.to_numpy())
            whose = _own(n_marks)
            most = np.zeros(len(n), np.int64)
            np.maximum.at(most, own, cls + 1)
            base = np.cumsum(most) - most
            at, done = base[whose] + marks.field(0).to_numpy(), marks.field(1).to_numpy(zero_copy_only=False)
            cols = []
            for which in (done, ~done):
                flags = np.zeros(most.sum() + 1, bool)
                flags[at[which]] = True
                use = flags[base[own] + cls]
                pair = pa.StructArray.from_arrays([pa.array(first[use], pa.int32()), pa.array(last[use], pa.int32())], names=["first", "last"])
                ends = np.append(0, np.cumsum(np.bincount(own[use], minlength=len(n))))
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=[*ROW, "id", "done", "todo"])

    pairs = "array<struct<first:int,last:int>>"
    return scratch.write(rows.mapInArrow(run, f"row long, twin long, id long, done {pairs}, todo {pairs}"), "settled")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """texts: row, twin, text, id, todo -> id, first, last, s1, s2, n. n is 1 for a window that the text holds once, 0 for runs of
    windows that it holds several times, and more for one of each of these, which stands for all (first is -1)."""
    names, kinds = ["id", "first", "last", "s1", "s2", "n"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 64):
            found = []
            for i in range(b.num_rows):
                data, todo = b.column(2)[i].as_py().encode(), b.column(4)[i].values
                first, last = (todo.field(f).to_numpy().astype(np.int64) for f in range(2))
                at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last, strict=True)]))
                keys, _, times, place = distinct(np.zeros(len(at), np.int64), list(window_hashes(data, at, length).T))
                many = times[place] > 1
                once, again = at[~many], at[many]
                new = np.flatnonzero(np.diff(again, prepend=-2) != 1)
                ends = again[np.append(new[1:], len(again)) - 1] if len(again) else again
                zero = np.zeros(len(new), np.int64)
                found.append([once, once, *(k[place[~many]] for k in keys), np.ones(len(once), np.int64)])
                found.append([again[new], ends, zero, zero, zero])
                found.append([np.full((times > 1).sum(), -1)] * 2 + [*(k[times > 1] for k in keys), np.minimum(times[times > 1], 1 << 30)])
                for f in found[-3:]:
                    f.insert(0, np.full(len(f[0]), b.column(3)[i].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "id long, first int, last int, s1 long, s2 long, n int")


def _with_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts joined with found (row, twin, ...)."""
    other = found.withColumnsRenamed({"row": "r", "twin": "t"})
    return likely(texts, found, "row").join(other, (F.col("row") == F.col("r")) & (F.col("twin") == F.col("t"))).drop("r", "t")


def repeated(texts: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """texts (row, twin, text) -> row, twin, done and more (runs of starts of windows that start elsewhere as well), shared
    (byte ranges of the phrases that other rows have, too)."""
    long = texts.where(F.octet_length("text") >= min(length, passage))
    scratch = Scratch()
    first = _ranked(_phrases(long, scratch), 0, passage, scratch)
    scratch.done(first)
    shared = materialize(first.where(F.size("shared") > 0).select(*ROW, "id", "shared"), "shared")
    state = first.where(F.size("a") > 0)
    for r in range(1, ROUNDS + 1):
        state = _ranked(state, r, passage, scratch)
        scratch.done(state)
    runs = _runs(state, length, scratch)
    scratch.done(runs)
    settled = _settle(runs, scratch)
    scratch.done(settled)
    todo = settled.where(F.size("todo") > 0).select(*ROW, "id", "todo")
    windows = scratch.write(_windows(_with_text(long, todo).select(*ROW, "text", "id", "todo"), length), "windows")
    key = ["s1", "s2"]
    found = scratch.write(_likely(windows.where("n > 0"), "s1"), "likely")
    again = scratch.write(found.groupBy(*key).agg(F.sum("n").alias("n")).where("n > 1"), "again")
    last = join_groups(found.where("n = 1").drop("n"), again, key).select("id", "first", "last")
    last = last.unionByName(windows.where("n = 0").select("id", "first", "last")).groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("more"))
    rows = shared.select(*ROW, "id", F.lit(None).cast("array<struct<first:int,last:int>>").alias("done"), "shared")
    rows = rows.unionByName(settled.where(F.size("done") > 0).select(*ROW, "id", "done"), allowMissingColumns=True).groupBy(*ROW, "id").agg(F.first("done", True).alias("done"), F.first("shared", True).alias("shared"))
    more = last.withColumnRenamed("id", "i").join(settled.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}_") for c in ROW)), "i")
    rows = rows.join(more, F.col("id") == F.col("i"), "full")
    rows = rows.select(*(F.coalesce(c, f"{c}_").alias(c) for c in ROW), "done", "more", F.coalesce("shared", F.array().cast("array<struct<first:int,last:int>>")).alias("shared"))
    rows = materialize(rows, "found")
    scratch.done()
    return rows


def _merged(first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that the windows cover."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + size)
    new = np.append(True, first[1:] > end[:-1])
    return first[new], np.append(end[:-1][new[1:]], end[-1:])


def _row(doc_id: str, text: Column) -> list[Column]:
    ident = F.col(f"`{doc_id}`")
    return [F.xxhash64(ident, text).alias("row"), F.xxhash64(F.lit(1), text, ident).alias("twin")]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and spans (byte ranges removed) of each document;
    keep_text: also kept_bytes, what is left of the text (it may begin or end inside a character)."""
    if length < 2 * REACH + GRAM or passage < 2 * REACH:
        raise ValueError("length and passage are no less than two reaches, length by a gram more")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *_row(doc_id, body), body.alias("text"))
    found = repeated(rows.select(*ROW, "text"), length, passage)
    touched = _with_text(rows, found)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 128):
            out = []
            for i in range(b.num_rows):
                data = b.column(3)[i].as_py().encode()
                at = [b.column(k)[i].values for k in (4, 5) if b.column(k)[i].is_valid]
                first, last = (np.concatenate([np.zeros(0, np.int64), *(x.field(f).to_numpy().astype(np.int64) for x in at)]) for f in range(2))
                starts, ends = _merged(first, last, length) if len(first) else (first, last)
                keep = np.split(np.frombuffer(data, np.uint8), np.stack([starts, ends], 1).ravel())[::2]
                kept = b"".join(k.tobytes() for k in keep)
                spans = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n_shared = sum(x["last"] - x["first"] for x in b.column(6)[i].as_py())
                out.append((len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), n_shared, spans, kept if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
            cols = [*b.columns[:3], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *ROW, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans", "kept_bytes"])

    spans_type = "array<struct<start:long,end:long>>"
    removed = touched.select("doc_id", *ROW, "text", "done", "more", "shared").mapInArrow(
        run, f"doc_id long, row long, twin long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans {spans_type}, kept_bytes binary"
    )
    removed = materialize(removed if keep_text else removed.drop("kept_bytes"), "removed")
    none, raw = F.lit(0).cast("long"), F.col("text").cast("binary")
    whole = rows.select(
        "doc_id", *ROW, F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), none.alias("n_shared"), F.array().cast(spans_type).alias("spans"), *([raw.alias("kept_bytes")] if keep_text else []),
    ).join(found.select(*ROW), ROW, "left_anti")
    out = removed.unionByName(whole).drop(*ROW)
    return out.withColumnRenamed("doc_id", doc_id)
