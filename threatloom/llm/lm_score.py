"""Language-model scoring by cross-entropy difference.

Two word bigram models of the same form and smoothing share one vocabulary: the words that occur ``MIN_COUNT`` times or
more in the target documents; every other word is ``<unk>``. The target model counts all documents that a labelled table
calls good and not toxic; the background model counts every bigram over the vocabulary in every document of the corpus. A document's score is the mean over its tokens of target loss less
background loss (nats): the lower, the more like the target.

    p(w) = (c(w) + ADD) / (N + ADD * words)        p(w | h) = (c(h, w) + PRIOR * p(w)) / (c(h) + PRIOR)

The vocabulary alone is gathered in one place: its words' hashes and counts, which grow far less than texts. Bigram counts grow with the corpus and
are never broadcast or collected. A bigram's key is a bijection of its two words' places, and ranges of keys are slices.
Tasks count bigrams by chunks of ``CHUNK`` tokens and hand each slice its sorted keys; a slice's counts are added up and
written. To score, each chunk sends every slice the bigrams its documents have there, the slice answers with sums of
losses for each document, and Spark adds these up. A bigram is one entry a document and chunk however often it occurs.
A slice's bigrams are bounded by the vocabulary, (words + 3)^2 / slices; what grows with the corpus is split: past
``MAX_SLICES`` slices chunks' counts are added up in two steps, and the questions to a slice of more than ``SALT_TOKENS``
tokens are dealt over salts, each with a copy of the slice's counts.

Cases: a null or empty text has no tokens, losses 0 and score 0; repeated rows are scored alike, each its own row;
labels that are null or repeat don't add to the target; without any good label all words are ``<unk>`` and the target is
uniform; documents that the models haven't counted are scored with counts of 0; an empty table gives no rows; further
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast, word_hashes

#: Ids of target documents up to which they are broadcast.
BROADCAST_IDS = 1_000_000
MIN_COUNT = 2
ADD, PRIOR = 0.5, 20.0
#: Tokens of a chunk; its documents' numbers have DOC_BITS bits.
CHUNK, DOC_BITS = 1 << 20, 16
#: Bytes of text for each slice, and how many slices there are at least and at most.
SLICE_BYTES, MIN_SLICES, MAX_SLICES = 16 << 20, 64, 4096
#: Tokens of a slice that one task answers for.
SALT_TOKENS = 4 << 20
_ODD = 0x9E3779B97F4A7C15
_ENTRIES = "slice int, kind int, n int, x binary, y binary, z binary"


@dataclass(frozen=True)
class Coder:
    """Places of words and keys of bigrams. Places after the vocabulary's: <unk>, a text's begin, no history."""

    words: np.ndarray  # sorted hashes of the vocabulary
    slices: int

    @property
    def unk(self) -> int:
        return len(self.words)

    @property
    def radix(self) -> int:
        return len(self.words) + 3

    @property
    def bits(self) -> int:
        return (self.radix**2 - 1).bit_length()

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text begins (one more entry than texts), and the places of each token's history and word."""
        ids, starts = word_hashes(texts)
        word = np.full(len(ids), self.unk, np.uint64)
        if self.unk:
            at = np.minimum(np.searchsorted(self.words, ids), self.unk - 1)
            known = self.words[at] == ids
            word[known] = at[known]
        history = np.concatenate([word[:1], word[:-1]])
        history[starts[:-1][starts[:-1] < starts[1:]]] = self.unk + 1
        return starts, history, word

    def keys(self, history: np.ndarray | int, word: np.ndarray) -> np.ndarray:
        pair = np.asarray(history, np.uint64) * np.uint64(self.radix) + word
        return pair * np.uint64(_ODD) & np.uint64((1 << self.bits) - 1)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(history, word) of keys."""
        pair = keys * np.uint64(pow(_ODD, -1, 1 << 64)) & np.uint64((1 << self.bits) - 1)
        return (pair // np.uint64(self.radix)).astype(np.int64), (pair % np.uint64(self.radix)).astype(np.int64)

    def cuts(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(slice, first, end) of each slice that sorted keys have."""
        high = max(0, self.bits - 32)  # 32 bits are enough to cut by, and don't overflow
        of = (keys >> np.uint64(high)) * np.uint64(self.slices) >> np.uint64(self.bits - high)
        first = np.flatnonzero(np.diff(of, prepend=~of[:1]))
        return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True))


def pack(x: np.ndarray, steps: bool = False) -> bytes:
    """Unsigned 64-bit integers by byte planes, compressed; steps: as differences."""
    x = np.ascontiguousarray(x, np.uint64)
    x = np.diff(x, prepend=np.uint64(0)) if steps else x
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, steps: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if steps else x


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["slice", "kind", "n", "x", "y", "z"])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _count(docs: DataFrame, coder: Coder) -> DataFrame:
    """docs (text, target boolean) -> for each chunk and slice: keys, background counts, target counts."""

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(found), return_counts=True)  # key and, as the last bit, target
        keys, at = np.unique(values >> np.uint64(1), return_index=True)
        background, target = np.add.reduceat(n, at), np.add.reduceat(n * (values & np.uint64(1)).astype(np.int64), at)
        return _entries([(k, 0, b - a, pack(keys[a:b], True), pack(background[a:b]), pack(target[a:b])) for k, a, b in coder.cuts(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b in _small(batches):
            starts, history, word = coder.places(b.column(0))
            n = np.diff(starts)
            flag = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            of_token = np.repeat(flag, n)
            begins = np.full(int((n > 0).sum()), coder.unk + 1, np.uint64)
            for h, w, f in ((history, word, of_token), (coder.unk + 2, word, of_token), (coder.unk + 2, begins, flag[n > 0])):
                found.append(coder.keys(h, w) << np.uint64(1) | f)
            size += len(word)
            if size >= CHUNK:
                yield counted(found)
                found, size = [], 0
        if size:
            yield counted(found)

    return docs.mapInArrow(run, _ENTRIES)


def _add_up(parts: DataFrame, spread: int = 1) -> DataFrame:
    """One row a slice, or one for each of spread shares of its chunks; holds one slice's sums and a few chunks at a time."""

    def merge(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, *counts = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], *(np.add.reduceat(c[order], at) for c in counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, fresh = None, [], 0

        def done() -> pa.RecordBatch:
            keys, background, target = merge(found)
            return _entries([(now, 0, len(keys), pack(keys, True), pack(background), pack(target))])

        for b in batches:
            for k, _, n, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    if found:
                        yield done()
                    now, found, fresh = k, [], 0
                found.append((unpack(x, n, True), unpack(y, n), unpack(z, n)))
                fresh += n
                if fresh > max(1 << 21, len(found[0][0])):  # so that merging costs a constant number of passes a doubling
                    found, fresh = [merge(found)], 0
        if found:
            yield done()

    if spread > 1:
        share = F.pmod(F.xxhash64("x"), F.lit(spread))
        return parts.withColumn("share", share).repartition("slice", "share").sortWithinPartitions("share", "slice").drop("share").mapInArrow(run, _ENTRIES)
    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, _ENTRIES)


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").dropna().distinct()


def vocabulary(target: DataFrame, min_count: int = MIN_COUNT) -> np.ndarray:
    """Sorted hashes of the words that target (text) has min_count times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = np.unique(word_hashes(b.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    rows = target.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("word")
    return np.sort(rows.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


@dataclass(frozen=True)
class Models:
    coder: Coder
    words: dict[str, np.ndarray]  # counts by place, of the background and the target
    pairs: DataFrame  # slices: keys, background counts, target counts
    salts: DataFrame  # slice, n_salts of slices of many tokens; MAX_SLICES rows at most
    tasks: int  # to answer in, so that a task's share doesn't grow with the corpus


def losses(counts: np.ndarray, history: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """-log p of each token: counts by place, the token's two places, its bigram's count."""
    p1 = (counts[word] + ADD) / (counts[:-1].sum() + ADD * (len(counts) - 1))
    return -np.log((pair + PRIOR * p1) / (counts[history] + PRIOR))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Models:
    target = materialize(target_ids(labels).select(F.col("doc_id").alias("__id")), "lm-target")
    body = F.col(f"`{text}`").cast("string").alias("text")
    rows = docs.join(sized_broadcast(target, BROADCAST_IDS), F.col(f"`{doc_id}`") == F.col("__id"), "left")
    rows = rows.select(body, F.col("__id").isNotNull().alias("target"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    need = max(MIN_SLICES, -(-int(size) // SLICE_BYTES))
    coder = Coder(vocabulary(rows.where("target").select("text")), min(MAX_SLICES, need))
    if coder.bits + DOC_BITS > 64:
        raise ValueError(f"the target documents have {coder.unk} words, more than a key can hold")
    counted, spread = _count(rows, coder), -(-need // MAX_SLICES)
    pairs = materialize(_add_up(_add_up(counted, spread) if spread > 1 else counted), "lm-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, *blobs in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                history, word = coder.split(unpack(blobs[0], n, True))
                alone = history == coder.unk + 2
                cols = [word[alone], *(unpack(x, n)[alone].astype(np.int64) for x in blobs[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["word", "background", "target"])

    found = pairs.mapInArrow(run, "word long, background long, target long").toArrow()  # the vocabulary's counts
    words = {}
    for name in ("background", "target"):
        words[name] = np.zeros(coder.unk + 2, np.int64)
        words[name][found["word"].to_numpy()] = found[name].to_numpy()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int(unpack(y, n).sum()) for n, y in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64())], names=["slice", "tokens"])

    salts = pairs.mapInArrow(load, "slice int, tokens long").where(F.col("tokens") > SALT_TOKENS)
    salts = materialize(salts.select("slice", F.ceil(F.col("tokens") / SALT_TOKENS).cast("int").alias("n_salts")), "lm-salts")
    return Models(coder, words, pairs, salts, need // 4)


def _ask(docs: DataFrame, coder: Coder) -> DataFrame:
    """docs (row, text) -> for each chunk and slice: keys with documents' numbers, rows of these documents, counts."""

    def asked(found: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(found), return_counts=True)
        ids, mask = np.concatenate(rows), np.uint64((1 << DOC_BITS) - 1)
        out = []
        for k, a, b in coder.cuts(values >> np.uint64(DOC_BITS)):
            docs_here, number = np.unique(values[a:b] & mask, return_inverse=True)
            x = (values[a:b] & ~mask) | number.astype(np.uint64)
            out.append((k, 1, b - a, pack(x, True), ids[docs_here.astype(np.int64)].tobytes(), pack(n[a:b])))
        return _entries(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, size, held = [], [], 0, 0
        for b in _small(batches):
            starts, history, word = coder.places(b.column(1))
            number = np.repeat(np.arange(held, held + b.num_rows, dtype=np.uint64), np.diff(starts))
            found.append(coder.keys(history, word) << np.uint64(DOC_BITS) | number)
            rows.append(b.column(0).to_numpy())
            size, held = size + len(word), held + b.num_rows
            if size >= CHUNK or held + 256 > 1 << DOC_BITS:
                yield asked(found, rows)
                found, rows, size, held = [], [], 0, 0
        if size:
            yield asked(found, rows)

    return docs.mapInArrow(run, _ENTRIES)


def _answer(asked: DataFrame, models: Models) -> DataFrame:
    """Questions -> row, n, target_loss, background_loss (sums over some of a document's tokens)."""
    coder = models.coder
    shared = asked.sparkSession.sparkContext.broadcast(models.words)  # the vocabulary's counts
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, none, names = None, np.zeros(0, np.uint64), ("target", "background")
        keys, counts = none, dict.fromkeys(names, none)
        for b in batches:
            for k, kind, n, x, y, z, salt in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, salt) != now:
                    now, keys, counts = (k, salt), none, dict.fromkeys(names, none)
                if kind == 0:
                    keys, counts = unpack(x, n, True), {"background": unpack(y, n), "target": unpack(z, n)}
                    continue
                values, times, rows = unpack(x, n, True), unpack(z, n).astype(np.float64), np.frombuffer(y, np.int64)
                number, asked = (values & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64), values >> np.uint64(DOC_BITS)
                history, word = coder.split(asked)
                at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                known = keys[at] == asked if len(keys) else np.zeros(n, bool)
                sums = [np.bincount(number, times, len(rows)).astype(np.int64)]
                for name in names:
                    pair = np.where(known, counts[name][at], 0).astype(np.float64) if len(keys) else np.zeros(n)
                    sums.append(np.bincount(number, times * losses(shared.value[name], history, word, pair), len(rows)))
                cols = [pa.array(c, t) for c, t in zip([rows, *sums], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "n", "target_loss", "background_loss"])

    n, salts = F.coalesce("n_salts", F.lit(1)), F.broadcast(models.salts)
    counts = models.pairs.join(salts, "slice", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
    questions = asked.join(salts, "slice", "left").withColumn("salt", F.pmod(F.xxhash64("y", "n"), n).cast("int"))
    rows = counts.unionByName(questions).drop("n_salts")
    few = models.tasks <= int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition("slice", "salt") if few else rows.repartition(models.tasks, "slice", "salt")
    rows = rows.sortWithinPartitions("slice", "salt", "kind")
    return rows.mapInArrow(run, "row long, n long, target_loss double, background_loss double")


def score(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc id, n_tokens, target_loss, background_loss (means, nats; to 9 digits) and ce_difference of each document."""
    body = F.col(f"`{text}`").cast("string")
    row = F.xxhash64(F.col(f"`{doc_id}`"), body)
    sums = _answer(_ask(docs.select(row.alias("row"), body.alias("text")), models.coder), models).groupBy(F.col("row").alias("r"))
    # sums of repeated rows are those of all copies, so means are right
    names = ("target_loss", "background_loss")
    means = materialize(sums.agg(*(F.round(F.sum(c) / F.sum("n"), 9).alias(c) for c in names)), "lm-means")
    n_tokens = F.coalesce(F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), row.alias("__row"), n_tokens.alias("n_tokens"))
    target, background = (F.coalesce(c, F.lit(0.0)) for c in names)
    return rows.join(means, F.col("__row") == F.col("r"), "left").select(
        F.col(f"`{doc_id}`"), "n_tokens", target.alias("target_loss"), background.alias("background_loss"), F.round(target - background, 9).alias("ce_difference")
    )


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
