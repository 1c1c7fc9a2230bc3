"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir, sized_broadcast  # noqa: F401  used by the operators here


#: Bits of the sketch of keys that a later step needs: it bounds what is broadcast at any size of input.
SKETCH_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of a job's steps; a step that is done gives back the space of all that it alone needed."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def done(self, *kept: DataFrame) -> None:
        """Overwrite all tables but those kept with empty ones."""
        for t in (t for t in self.tables if not any(t is k for k in kept)):
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                t.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)
        self.tables = list(kept)


def join_groups(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table of their groups (on, n, ...), inner or left.

    Groups of more than a thousandth of all grouped rows are fewer than a thousand and are broadcast, so no task gets a hot
    group's rows; the others are shuffled.
    """
    total, most = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most * 1000 <= total:
        return rows.join(found, on, how)
    hot = F.broadcast(found.where(F.col("n") * 1000 > total))
    rest = rows.join(hot.select(*on), on, "left_anti").join(found.where(F.col("n") * 1000 <= total), on, how)
    return rows.join(hot, on).unionByName(rest)


def likely(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows whose key is probably among found's: a sketch of SKETCH_BITS bits keeps most others out of the shuffle; one that is
    more than half full is left aside."""
    bit = F.pmod(F.xxhash64(key), F.lit(SKETCH_BITS))
    parts = (
        found.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
        .collect()
    )
    sketch = np.zeros(SKETCH_BITS // 8, np.uint8)
    for p in parts:
        sketch[(p["part"] - 1) * 4096 : p["part"] * 4096] = np.frombuffer(p["bits"], np.uint8)
    if int(np.bitwise_count(sketch).sum()) > SKETCH_BITS // 2:
        return rows
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def there(at: pa.Array) -> pa.Array:
        bit = at.to_numpy()
        return pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))

    return rows.where(F.arrow_udf(there, "boolean")(bit))  # only the bit's number goes through Python


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A written copy of rows with __nth, the place (from 0) inside each group by order, and __total, the group's rows.

    Rows are sorted by ranges of (group, order, an arbitrary number), so a group of any size, of equal rows too, lies in
    several tasks; places follow from counts by range, a table of as many rows as there are ranges and groups.
    """
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order).drop("__tie")
    at = F.monotonically_increasing_id()
    rows = materialize(ranged.withColumns({"__range": F.shiftright(at, 33).cast("int"), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = rows.groupBy("__range", group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", group, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(group)).alias("__total"))
    rows = rows.join(sized_broadcast(materialize(starts, "starts"), 50_000), ["__range", group])
    return rows.withColumn("__nth", F.col("__start") + F.col("__at") - F.col("__first")).drop("__range", "__at", "__first", "__start")


def groups(batches: Iterable, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of runs of equal keys (the first n_keys columns) in batches that are sorted by them."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts in a row, and where each text begins (one more entry than texts)."""
    import xxhash

    lists = pc.split_pattern_regex(pc.utf8_trim(pc.fill_null(texts, ""), " \t\n\x0b\x0c\r"), r"[ \t\n\x0b\x0c\r]+")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    empty = xxhash.xxh64_intdigest("")
    ids = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    keep = ids != np.uint64(empty)  # an empty text splits into one empty word
    starts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return ids[keep], starts
