"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def _mark(edges: DataFrame) -> tuple:
    """Identifies a set of edges: their number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))).first())


#: Edges that one task thins out.
THIN = 1 << 22


def hook(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots of nodes 0.. (the least node each is joined with) after the edges (p, q) were added to those of before."""
    while True:
        a, b = root[p], root[q]
        open_ = a != b
        if not open_.any():
            return root
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above


def thin(edges: DataFrame, size: int = THIN) -> DataFrame:
    """Edges (a, b long) with the same components, fewer of them: size at a time become a forest, as long as that saves a quarter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [np.zeros((2, 0), np.int64)], 0

        def forest() -> np.ndarray:
            both = np.concatenate(found, axis=1)
            nodes, at = np.unique(both, return_inverse=True)
            at = at.reshape(both.shape)
            root = hook(np.arange(len(nodes)), at[0], at[1])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return np.stack([nodes[moved], nodes[root[moved]]])

        for b in batches:
            found.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            held += b.num_rows
            if held > 2 * max(size, found[0].shape[1]):
                found = [forest()]
                held = found[0].shape[1]
        yield pa.RecordBatch.from_arrays([*map(pa.array, forest())], names=["a", "b"])

    now = materialize(edges.select("a", "b"), "edges")
    n = now.count()
    while n > size:
        fewer = materialize(now.repartition(-(-n // size)).mapInArrow(run, "a long, b long"), "thin")
        now, last, n = fewer, n, fewer.count()
        if 4 * n > 3 * last:
            break
    return now


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a, b long) -> (node, label): label is the least node of the component; nodes without an edge to another
    node don't appear.

    Minima are written before they are joined back, so both sides of each join are plain shuffles and a node with very
    many edges can be split by the skewed-join rule. The number of rounds is logarithmic in a component's size.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b"), "large")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"), "down")
        small = large.join(down, F.col("a") == F.col("k")).select("b", "m").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = materialize(small.unionByName(down.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
