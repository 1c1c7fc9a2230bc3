"""Vectors, similarity and story clustering."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, sized_broadcast
from ..sources.upsert import upsert
from .blocks import meet, pack
from .graph import components, thin
from .linkage import nearest_clusters, tight_groups
from .reports import since, top_k
from .products import Entries, all_products, entries, products, rows_of, some_common
from .similarity import assign_nearest, linked, matrix, similarity_join, some_neighbours, unit as _unit  # noqa: F401  F4 and F6 are used from here, too

#: Vectors of one block: a task compares two blocks, whatever the number of vectors.
BLOCK = 512
#: Vectors of one block in a round of average linkage.
LINKAGE_BLOCK = 8192
#: Profiles of one block, and of those the kinds and the new ones that are compared at a time; rows of one batch of results.
PROFILE_BLOCK, PROFILE_TILE, TITLE_TILE, OUT_ROWS = 8192, 256, 512, 1 << 17
#: Grams of titles that one in so many pairs share go through a matrix product.
COMMON_GRAMS = 256
TOKEN = r"[\p{L}\p{N}_]{2,}"


def rounded(c: str | Column, digits: int = 6) -> Column:
    """What F.round gives for a double, without decimals unless the number is about half way between two results."""
    c = F.col(c) if isinstance(c, str) else c
    x = c * 10.0**digits
    plain = (F.abs(c) < 1e5) & (F.abs(x - F.floor(x) - 0.5) > 1e-4)
    return F.when(plain, F.floor(x + 0.5) / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def unclustered(articles: DataFrame, hits: DataFrame, members: DataFrame, clusters: DataFrame, as_of: str, hours: int) -> DataFrame:
    """articles of the window that name an entity and are in no active cluster."""
    recent = articles.where(F.col("published_at") >= since(as_of, hours)).join(hits.select("article_id").distinct(), "article_id", "left_semi")
    taken = members.join(clusters.where("is_active").select("cluster_id"), "cluster_id", "left_semi").select("article_id").distinct()
    return recent.join(taken, "article_id", "left_anti")


def vector_text(title: str = "title", content: str = "content") -> Column:
    """the title twice, a blank line, the content."""
    t = F.coalesce(title, F.lit(""))
    return F.concat(t, F.lit(" "), t, F.lit("\n\n"), F.coalesce(content, F.lit("")))


def text_vectors(df: DataFrame, text: Column | None = None) -> DataFrame:
    """article_id, term, weight: unit TF-IDF vectors in long form, idf = ln((1 + n) / (1 + df)) + 1.

    Texts are moved once, to their article's task, and counted there; idf is joined as a table by hashing, without sorting terms,
    and a vector's norm is summed where its rows meet again, so they are joined and moved once.
    """
    texts = df.select("article_id", (vector_text() if text is None else text).alias("t")).repartition("article_id")
    tokens = texts.select("article_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN), F.lit(0))).alias("term"))
    tf = materialize(tokens.groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("article_id").isNotNull()), "tf")
    n = df.count()
    idf = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(F.col("term").alias("t"), (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    rows = tf.join(idf.hint("shuffle_hash"), F.col("term") == F.col("t")).select("article_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("article_id")))  # a vector's own terms
    return rows.select("article_id", "term", (F.col("w") / norm).alias("weight"))


def block_pairs(vec: DataFrame, compare: Callable, schema: str, by: str | None = None, size: int = BLOCK) -> DataFrame:
    """Compare all vectors (id, vec[, by]) of a group with each other, two blocks of about ``size`` at a time.

    compare(ids a, unit vectors a, ids b, unit vectors b, same block, group) -> DataFrame. Each vector is sent once for
    each block of its group, so exact results need no pair to be a row unless it is one of the result.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    rows = vec.where(F.col("vec").isNotNull()).select(group.alias("g"), "id", "vec")
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n_blocks"))
    sizes = materialize(sizes.select(F.col("g").alias("k"), "n_blocks"), "blocks")
    rows = rows.join(sizes, F.col("g") == F.col("k")).withColumn("b", F.pmod(F.xxhash64("id"), "n_blocks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "vec")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, i, j = key
        one, two = pdf[pdf.b == i].sort_values("id"), pdf[pdf.b == j].sort_values("id")
        if not len(one) or not len(two):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x, y = (_unit(np.array(p.vec.tolist(), np.float64)) for p in (one, two))
        return compare(one.id.to_numpy(), x, two.id.to_numpy(), y, i == j, g)

    return rows.groupBy("g", "i", "j").applyInPandas(run, schema)


def representatives(clusters: DataFrame, members: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """one primary article (the least id) of each active cluster of the last three days."""
    recent = clusters.where("is_active").where(F.col("created_at") >= since(as_of, hours)).select("cluster_id")
    return members.where("is_primary").join(recent, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.min("article_id").alias("article_id"))


def dbscan(edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """id, label of density clusters over edges (i, j) at the threshold; a point counts as its own neighbour. Core points
    are joined by components, border points go to the least label of a core neighbour, noise is left out."""
    both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    core = materialize(both.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select("i"), "core")
    inner = both.join(core, "i", "left_semi").join(core.select(F.col("i").alias("j")), "j", "left_semi")
    labels = components(inner.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("node").alias("i"), "label")
    labels = materialize(core.join(labels, "i", "left").select("i", F.coalesce("label", "i").alias("label")), "labels")
    border = both.join(core, "i", "left_anti").join(labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("label"))
    return labels.unionByName(border).select(F.col("i").alias("id"), "label")


def dbscan_vectors(vec: DataFrame, threshold: float, min_samples: int = 2) -> DataFrame:
    """what dbscan gives over all pairs of vectors (id, vec) at the threshold, without the pairs.

    Block pairs give forests of the core points' links; which points are core, and what the others are next to, follows from
    less than min_samples neighbours a point and block pair.
    """
    if min_samples <= 2:  # all that have a neighbour are core
        return components(thin(linked(vec, threshold))).select(F.col("node").alias("id"), "label")
    some = materialize(some_neighbours(vec, threshold, min_samples - 1).distinct(), "neighbours")
    core = materialize(some.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select("i"), "core")
    inner = vec.join(core, F.col("id") == F.col("i"), "left_semi")
    labels = components(thin(linked(inner, threshold))).select(F.col("node").alias("i"), "label")
    labels = materialize(core.join(labels, "i", "left").select("i", F.coalesce("label", "i").alias("label")), "labels")
    border = some.join(core, "i", "left_anti").join(labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("label"))
    return labels.unionByName(border).select(F.col("i").alias("id"), "label")


def _solve_linkage(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Average linkage of a group (id, vec, c: the cluster it starts in) in one task; the label is the cluster's least id."""
    pdf = pdf.sort_values(["c", "id"])
    x = _unit(np.array(pdf.vec.tolist(), np.float64))
    names, starts, size = np.unique(pdf.c.to_numpy(), return_index=True, return_counts=True)
    sums = np.add.reduceat(np.add.reduceat(np.clip(x @ x.T, 0, 1), starts, axis=0), starts, axis=1)
    dist, size, owner = 1 - sums / np.outer(size, size), size.astype(np.float64), np.arange(len(names))
    np.fill_diagonal(dist, np.inf)
    while len(names) > 1:
        a, b = sorted(np.unravel_index(dist.argmin(), dist.shape))
        if not dist[a, b] < 1 - threshold:
            break
        merged = (dist[a] * size[a] + dist[b] * size[b]) / (size[a] + size[b])
        dist[a], dist[:, a] = merged, merged
        dist[b], dist[:, b], dist[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        owner[owner == b] = a
    return pd.DataFrame({"id": pdf.id.to_numpy(), "label": names[np.repeat(owner, np.diff(np.append(starts, len(pdf))))]})


def _linkage_rounds(rows: DataFrame, threshold: float, max_size: int, size: int = LINKAGE_BLOCK) -> DataFrame:
    """id, label by average linkage of components (g) of any size; rows: g, id, vec.

    Equal vectors and groups that surely merge before all else start as clusters. A round merges all pairs of clusters that are each
    other's nearest. A merged cluster is no nearer to a third one than the nearer of its parts, so this gives the clusters of one
    merge at a time; a cluster without another below 1 - threshold is done and leaves, and only those are compared anew that
    merged or whose nearest one did. What is left of a component is solved in one task when it has at most max_size vectors.
    """
    rows = materialize(rows, "vectors")
    of = rows.select("g", "id", F.col("id").alias("c"))
    if 0 < threshold < 1:  # equal vectors merge before all others
        of = rows.join(rows.groupBy("g", "vec").agg(F.min("id").alias("c")), ["g", "vec"]).select("g", "id", F.when(F.aggregate("vec", F.lit(0.0), lambda t, v: t + v.cast("double") * v) > 0, F.col("c")).otherwise(F.col("id")).alias("c"))
    of, done, kept = materialize(of, "clusters"), [], None
    if 0 < threshold < 1:
        groups = tight_groups(rows.join(of.where("c = id").select("id"), "id", "left_semi"), threshold, size).select(F.col("id").alias("k"), F.col("c").alias("least"))
        of = materialize(of.join(groups, F.col("c") == F.col("k"), "left").select("g", "id", F.coalesce("least", "c").alias("c")), "clusters")
    while True:
        rest = materialize(of.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_size).select("g"), "rest")
        if rest.count():
            last = of.join(rest, "g", "left_semi").join(rows.select("id", "vec"), "id")
            done.append(materialize(last.groupBy("g").applyInPandas(lambda p: _solve_linkage(p, threshold), "id long, label long"), "solved"))
            of = materialize(of.join(rest, "g", "left_anti"), "clusters")
        if of.isEmpty():
            break
        sizes = materialize(of.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "sizes")
        if kept is not None:  # a nearest cluster that was found before stays so as long as neither of both merged
            kept = materialize(kept.join(sizes.select(F.col("c").alias("a")), "a", "left_semi").join(sizes.select(F.col("c").alias("b")), "b", "left_semi").select("a", "b", "sim"), "kept")
        dirty = sizes.select("c") if kept is None else sizes.select("c").join(kept.select(F.col("a").alias("c")), "c", "left_anti")
        members = of.join(sizes, "c").join(rows.select("id", "vec"), "id").select("g", "id", "vec", "c", "n")
        near = nearest_clusters(members, materialize(dirty, "dirty"), threshold, size)
        near = materialize(near if kept is None else near.unionByName(kept), "near")
        merge = materialize(near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi").where("a < b").select("a", "b"), "merge")
        if merge.isEmpty():  # sums that differ in their last digits: the nearest pair of all
            merge = materialize(near.orderBy(F.desc("sim"), "a", "b").limit(1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "merge")
        live = materialize(near.select(F.col("a").alias("c")).unionByName(merge.select(F.explode(F.array("a", "b")).alias("c"))).distinct(), "live")
        done.append(of.join(live, "c", "left_anti").select("id", F.col("c").alias("label")))
        of = of.join(live, "c", "left_semi").join(merge, F.col("c") == F.col("b"), "left").select("g", "id", F.coalesce("a", "c").alias("c"))
        of = materialize(of, "clusters")
        moved = merge.select(F.explode(F.array("a", "b")).alias("k"))
        kept = near.join(moved.withColumnRenamed("k", "a"), "a", "left_anti").join(moved.withColumnRenamed("k", "b"), "b", "left_anti")
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def average_linkage(edges: DataFrame, vec: DataFrame, threshold: float, max_size: int = 2000) -> tuple[DataFrame, DataFrame]:
    """F8: (id, label by average linkage while the mean distance is below 1 - threshold; label, n of components above max_size).

    A merge needs a pair at the threshold, so no cluster leaves a connected component of the edges: each is solved alone, in
    one task up to max_size vectors and in rounds above; the first table holds both.
    """
    labels = materialize(components(edges.select(F.col("i").alias("a"), F.col("j").alias("b"))), "linkage")
    sizes = materialize(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > max_size).select("label", "n")
    rows = labels.join(sizes, "label").select(F.col("label").alias("g"), F.col("node").alias("id"), "n").join(vec.select("id", "vec"), "id")
    small = rows.where(F.col("n") <= max_size).select("g", "id", "vec", F.col("id").alias("c"))
    linked = small.groupBy("g").applyInPandas(lambda p: _solve_linkage(p, threshold), "id long, label long")
    if not large.isEmpty():
        linked = linked.unionByName(_linkage_rounds(rows.where(F.col("n") > max_size).select("g", "id", "vec"), threshold, max_size))
    return linked, large


def cluster_articles(vec: DataFrame, threshold: float, min_samples: int = 2) -> DataFrame:
    """F7, or F8 if F7 gives fewer clusters than a tenth of the vectors and F8 gives more."""
    one = materialize(dbscan_vectors(vec, threshold, min_samples), "dbscan")
    n, n1 = vec.count(), one.select("label").distinct().count()
    if n1 >= n / 10:
        return one
    # with two samples F7's clusters are the components of all pairs at the threshold, which needn't be compared again
    edges = one.select(F.col("id").alias("i"), F.col("label").alias("j")) if min_samples <= 2 else thin(linked(vec, threshold)).toDF("i", "j")
    joined = materialize(average_linkage(edges, vec, threshold)[0], "linkage")
    two = materialize(joined.join(joined.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label"), "label", "left_semi").select("id", "label"), "linked")
    return two if two.select("label").distinct().count() > n1 else one


#: Labels whose sums a task holds before it passes them on, and rows of sums up to which they are broadcast.
HELD_LABELS, BROADCAST_SUMS = 1024, 10_000
_SUMS = "label long, n long, total array<double>, units array<double>, directed long"


def label_sums(labels: DataFrame, vec: DataFrame) -> DataFrame:
    """label, n, total (the sum of its members' vectors), units (of their unit vectors) and directed (members that aren't zero).

    Sums are taken in each task over Arrow batches and added up by label, a row a label and task; no dimension is a row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            cols = [[*held], *(list(c) for c in zip(*held.values(), strict=True))]
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["label", "n", "total", "units", "directed"])

        for b in batches:
            x = matrix(b.column(1))
            u, names = _unit(x), b.column(0).to_numpy()
            found, at = np.unique(names, return_inverse=True)
            total, units = np.zeros((len(found), x.shape[1])), np.zeros((len(found), x.shape[1]))
            np.add.at(total, at, x)
            np.add.at(units, at, u)
            n, directed = np.bincount(at), np.bincount(at, weights=(np.abs(u).sum(axis=1) > 0)).astype(np.int64)
            for k, label in enumerate(found.tolist()):
                old = held.get(label)
                new = [int(n[k]), total[k], units[k], int(directed[k])]
                held[label] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
            if len(held) > HELD_LABELS:
                yield out()
        if held:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        one = [[float(v) for v in matrix(table[c]).sum(axis=0)] for c in ("total", "units")]
        return pa.table({"label": table["label"].slice(0, 1), "n": [int(np.sum(table["n"].to_numpy()))], "total": [one[0]], "units": [one[1]], "directed": [int(np.sum(table["directed"].to_numpy()))]})

    rows = labels.join(vec.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec")), "id")
    return rows.select(F.col("label").cast("long"), "vec").mapInArrow(partial, _SUMS).groupBy("label").applyInArrow(add, _SUMS)


def _against(labels: DataFrame, vec: DataFrame, sums: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """label, id, value: measure(vectors, totals, sizes of their labels) of each member; sums: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = measure(matrix(b.column(2)), matrix(b.column(3)), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value)], names=["label", "id", "value"])

    rows = labels.join(vec.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec")), "id")
    rows = rows.join(sized_broadcast(sums, BROADCAST_SUMS), "label").select(F.col("label").cast("long"), F.col("id").cast("long"), "vec", *sums.columns[1:])
    return rows.mapInArrow(run, "label long, id long, value double")


def coherence(labels: DataFrame, vec: DataFrame, report: dict | None = None) -> DataFrame:
    """label, size, coherence: the mean similarity (0 to 1) over all pairs of members, 1 for one member.

    If all members are within 45 degrees of their sum, no two are further apart than 90, so no similarity is negative and the
    sum over pairs is (|sum of unit vectors|^2 - n) / 2: no pair is looked at. Only labels beyond that bound are compared in blocks.

    report: gets ``compared``, the labels whose pairs were.
    """
    sums = materialize(label_sums(labels, vec), "sums")
    towards = lambda x, s, n: np.where(np.abs(x).sum(axis=1) > 0, (_unit(x) * _unit(s)).sum(axis=1), 1.0)
    near = _against(labels, vec, sums.select("label", "units", "n"), towards).groupBy("label").agg(F.min("value").alias("near"))
    square = F.aggregate("units", F.lit(0.0), lambda t, v: t + v * v)
    closed = F.when(F.col("n") > 1, (square - F.col("directed")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    rows = materialize(sums.join(near, "label").select("label", F.col("n").alias("size"), closed.alias("coherence"), (F.col("near") >= math.sqrt(0.5) + 1e-9).alias("tight")), "tight")
    loose = rows.where("NOT tight AND size > 1").select("label")
    if report is not None:
        report["compared"] = loose.count()

    def compare(a, x, b, y, same, g):
        sim = np.clip(x @ y.T, 0, 1)
        total, n = (np.triu(sim, 1).sum(), len(a) * (len(a) - 1) // 2) if same else (sim.sum(), sim.size)
        return pd.DataFrame({"g": [g], "total": [float(total)], "pairs": [int(n)], "members": [len(a) if same else 0]})

    some = labels.join(loose, "label", "left_semi").join(vec.select("id", "vec"), "id")
    parts = block_pairs(some, compare, "g string, total double, pairs long, members long", by="label")
    means = parts.groupBy("g").agg(F.sum("total").alias("t"), F.sum("pairs").alias("p"), F.sum("members").alias("size"))
    means = means.select(F.col("g").cast("long").alias("label"), "size", F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(1.0).alias("coherence"))
    done = rows.where("tight OR size = 1").select("label", "size", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "coherence")).alias("coherence"))
    return done.unionByName(means)


def valid_clusters(labels: DataFrame, dates: DataFrame, vec: DataFrame, least: int = 2, most: int = 25, hours: int = 168, threshold: float = 0.75) -> DataFrame:
    """labels of an allowed size, date span and coherence."""
    spans = labels.join(dates, "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.unix_seconds(F.max("published_at").cast("timestamp")) - F.unix_seconds(F.min("published_at").cast("timestamp"))).alias("span"))
    good = spans.where(F.col("n").between(least, most) & (F.col("span") <= hours * 3600))
    return good.join(coherence(labels.join(good.select("label"), "label", "left_semi"), vec).select("label", "coherence"), "label").where(F.col("coherence") >= threshold)


def primary_article(labels: DataFrame, vec: DataFrame) -> DataFrame:
    """label, id: the member at the least Euclidean distance of its centroid, the least id of equals."""
    sums = materialize(label_sums(labels, vec).select("label", "total", "n"), "sums")
    gap = lambda x, s, n: np.round(((x - s / n[:, None]) ** 2).sum(axis=1), 9)
    return _against(labels, vec, sums, gap).groupBy("label").agg(F.min(F.struct(F.col("value").alias("d"), "id")).alias("__m")).select("label", "__m.id")


def member_similarity(labels: DataFrame, vec: DataFrame) -> DataFrame:
    """label, id, similarity: the cosine of each member to its centroid."""
    sums = materialize(label_sums(labels, vec).select("label", "total", "n"), "sums")
    cosine = lambda x, s, n: (_unit(x) * _unit(s)).sum(axis=1)
    return _against(labels, vec, sums, cosine).select("label", "id", F.round("value", 6).alias("similarity"))


def active_clusters(clusters: DataFrame, as_of: str, hours: int = 14 * 24) -> DataFrame:
    """the active clusters of the last 14 days, which new ones are compared with."""
    return clusters.where("is_active").where(F.col("created_at") >= since(as_of, hours))


def cluster_profiles(members: DataFrame, articles: DataFrame, hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """per cluster the sorted arrays of article ids, titles, feeds and "category:name" entities."""
    rows = members.join(clusters.select("cluster_id"), "cluster_id", "left_semi").join(articles.select("article_id", "title", "feed"), "article_id")
    own = rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set("article_id")).alias("article_ids"), F.sort_array(F.collect_set("title")).alias("titles"), F.sort_array(F.collect_set("feed")).alias("feeds"))
    named = rows.select("cluster_id", "article_id").join(hits.select("article_id", F.concat("category", F.lit(":"), "name").alias("e")), "article_id").groupBy("cluster_id").agg(F.sort_array(F.collect_set("e")).alias("entities"))
    return own.join(named, "cluster_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Size of the intersection over that of the union; 0 if either set is empty."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


#: Weights of key entities by category.
KEY_WEIGHTS = {"apt_group": 1.0, "ransomware_group": 1.0, "malware_family": 0.9, "campaign": 0.8, "vulnerability": 1.0, "company": 0.7}


def _key_entities(entities: Column) -> Column:
    """The distinct lower-case entities of the key categories."""
    return F.array_distinct(F.transform(F.filter(entities, lambda e: F.substring_index(e, ":", 1).isin(*KEY_WEIGHTS)), F.lower))


def _title_grams(titles: Column) -> Column:
    """Hashes of the 1- and 2-grams of titles, as often as they occur."""

    def grams(w: Column) -> Column:
        two = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.transform(F.concat(w, two), lambda g: F.xxhash64(g))

    words = F.regexp_extract_all(F.lower(F.array_join(titles, " ")), F.lit(TOKEN), F.lit(0))
    return F.get(F.transform(F.array(words), grams), F.lit(0))  # bound, so words are looked for once


def _key_match(names: np.ndarray, one: Entries, two: Entries, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """F18 of rows p of one and q of two: weights of the common key entities over those of all, each summed in the order of the arrays."""
    weight = np.array([KEY_WEIGHTS[str(n).split(":", 1)[0]] for n in names], np.float64)
    kinds, keys = [], []
    for side, at in ((one, p), (two, q)):  # rows with equal key entities are compared once
        lists = np.split(side.code, np.cumsum(np.bincount(side.row, minlength=side.n))[:-1])
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(x.tobytes(), len(number)) for x in lists], np.int64)
        kinds.append([np.frombuffer(x, side.code.dtype) for x in number])
        keys.append(kind[at])
    pairs, back = np.unique(keys[0] * len(kinds[1]) + keys[1], return_inverse=True)
    a, b = pairs // max(1, len(kinds[1])), pairs % max(1, len(kinds[1]))

    def padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        table = np.full((len(lists), max(map(len, lists), default=0)), -1, np.int64)
        has = np.zeros((len(lists), len(names) + 1), bool)
        for k, x in enumerate(lists):
            table[k, : len(x)], has[k, x] = x, True
        return table, has

    (x, in_x), (y, in_y) = padded(kinds[0]), padded(kinds[1])
    weight = np.append(weight, 0.0)  # of the padding, -1
    every, both = np.zeros(len(pairs)), np.zeros(len(pairs))
    for k in range(x.shape[1]):
        every += weight[x[a, k]]
        both += np.where(in_y[b, x[a, k]], weight[x[a, k]], 0.0)
    for k in range(y.shape[1]):
        every += np.where(in_x[a, y[b, k]], 0.0, weight[y[b, k]])
    return np.divide(both, every, out=np.zeros(len(pairs)), where=every > 0)[back]


@dataclass
class _Profiles:
    """Profiles of a block, those of one kind (equal entities and feeds) in a row: the table, each one's kind and each kind's first row;
    and the grams of titles as rows, hashes and numbers, and the sum of squares of each profile's numbers."""

    table: pa.Table
    kind: np.ndarray
    first: np.ndarray
    grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    squares: np.ndarray | None

    @functools.cached_property
    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams, in order, and each gram's place among them."""
        return np.unique(self.grams[1], return_inverse=True)


def _profiles(table: pa.Table) -> _Profiles:
    number: dict[tuple, int] = {}
    kind = np.array([number.setdefault((tuple(e or ()), tuple(f or ())), len(number)) for e, f in zip(table["entities"].to_pylist(), table["feeds"].to_pylist(), strict=True)], np.int64)
    order = np.argsort(kind, kind="stable")
    table, kind = table.take(pa.array(order)).combine_chunks(), kind[order]
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    if "grams" not in table.column_names:
        return _Profiles(table, kind, first, None, None)
    lists = table["grams"].combine_chunks()
    row, gram = rows_of(lists), lists.flatten().to_numpy(zero_copy_only=False)  # in order
    at = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(gram, prepend=0) != 0))
    n = np.diff(np.append(at, len(row))).astype(np.float64)
    return _Profiles(table, kind, first, (row[at], gram[at], n), np.bincount(row[at], n * n, minlength=len(table)))


def _common_grams(one: _Profiles, two: _Profiles, in_codes: bool) -> tuple[Entries, Entries]:
    """The grams that both blocks have, under common codes; those of two in order of codes, or else of rows."""
    names, place = one.numbered
    (row, _, n), (others, gram, m) = one.grams, two.grams
    found = np.minimum(np.searchsorted(names, gram), max(0, len(names) - 1))
    known = names[found] == gram if len(names) else np.zeros(len(gram), bool)
    used = np.unique(found[known])
    code = np.full(len(names), -1)
    code[used] = np.arange(len(used))
    mine, known = code[place], np.flatnonzero(known)
    known = known[np.argsort(code[found[known]], kind="stable")] if in_codes else known
    return Entries(len(one.kind), row[mine >= 0], mine[mine >= 0], n[mine >= 0]), Entries(len(two.kind), others[known], code[found[known]], m[known])


#: A pair of profiles whose key entities match by more than STRONG is a duplicate from STRONG_LEAST on, others from LEAST on;
#: the share of titles in the blend.
STRONG, STRONG_LEAST, LEAST, TITLES = 0.8, 0.65, 0.75, 0.3


def _able(art: np.ndarray | float, ent: np.ndarray, src: np.ndarray, key: np.ndarray, ttl: np.ndarray | float) -> np.ndarray:
    """Whether the blend (F19) may reach its threshold, as far as sums in another order and rounding can tell."""
    strong = key > STRONG
    blend = np.where(strong, 0.05 * art + 0.5 * ent + 0.05 * src + 0.1 * key, 0.2 * art + 0.4 * ent + 0.1 * src) + TITLES * ttl
    return blend >= np.where(strong, STRONG_LEAST, LEAST) - 1e-5


def _profile_pairs(new: DataFrame, existing: DataFrame, least: float, scored: bool, able: bool = False) -> DataFrame:
    """new_id, old_id, art, ent, src of profile pairs that share an article or entity or, with least > 0, whose entities overlap by that
    much; scored: with key (F18) and ttl (F17), too; able: only pairs that can be duplicates.

    Profiles are dealt in blocks by kind, and each block of new ones meets each of existing ones in one task that counts what all its
    pairs share, entities and feeds once a pair of kinds, some rows at a time: a pair is a row only as a result, and neither pairs
    nor copies of profiles are shuffled or stored.
    """

    def side(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("cluster_id").isNotNull())
        rows = rows.where(F.size("entities") > 0) if least > 0 else rows
        return materialize(rows.select("cluster_id", "article_ids", "entities", "feeds", *([_key_entities(F.col("entities")).alias("keys"), F.sort_array(_title_grams(F.col("titles"))).alias("grams")] if scored else [])), "profiles")

    sides = side(new), side(existing)
    counts = [df.count() for df in sides]
    blocks = [max(1, -(-n // PROFILE_BLOCK)) for n in counts]
    cores = new.sparkSession.sparkContext.defaultParallelism
    blocks[1] = max(blocks[1], min(-(-counts[1] // PROFILE_TILE), -(-2 * cores // blocks[0])))  # work for all cores, in tables that are small
    dealt = [pack(df.repartitionByRange(n, F.xxhash64("entities", "feeds"), F.xxhash64("cluster_id")), F.spark_partition_id(), name) for df, n, name in zip(sides, blocks, ("new", "old"), strict=True)]
    names = ["new_id", "old_id", "art", "ent", "src", *(["key", "ttl"] if scored else [])]
    c2 = float((1 + np.log(1.5)) ** 2)

    def shares(one: Entries, two: Entries, common: np.ndarray) -> np.ndarray:
        return common / np.maximum(one.size[:, None] + two.size[None, :] - common, 1)

    def run(_i: int, one: _Profiles, _j: int, two: _Profiles) -> Iterator[pa.RecordBatch]:
        ids = [t.table["cluster_id"].combine_chunks() for t in (one, two)]
        kinds = {c: entries(one.table[c].take(pa.array(one.first)), two.table[c].take(pa.array(two.first))) for c in ("entities", "feeds", *(["keys"] if scored else []))}
        articles = entries(one.table["article_ids"], two.table["article_ids"])
        shared = bool(np.intersect1d(articles[0].code, articles[1].code).size)
        grams = _common_grams(one, two, not able) if scored else None
        starts, width = np.append(one.first, len(one.kind)), len(two.first)
        for k in range(0, len(one.first), PROFILE_TILE):
            x, y = ({c: v[side].part(k, k + PROFILE_TILE) if side == 0 else v[side] for c, v in kinds.items()} for side in (0, 1))
            common = products(x["entities"].ones(), y["entities"].ones())
            ent, src = shares(x["entities"], y["entities"], common), shares(x["feeds"], y["feeds"], products(x["feeds"].ones(), y["feeds"].ones()))
            near = (common > 0) & (ent >= least)
            key, take = np.zeros(near.shape), near
            if scored:
                p, q = np.nonzero(near)
                key[p, q] = _key_match(kinds["keys"][2], x["keys"], y["keys"], p, q)
            if able:
                take = near & _able(0.0, ent, src, key, 1.0)
            end = starts[min(k + PROFILE_TILE, len(one.first))]
            for at in range(starts[k], end, TITLE_TILE):
                rows = np.arange(at, min(at + TITLE_TILE, end))
                of = one.kind[rows] - k
                wanted, art = take[of][:, two.kind], None
                if shared:
                    both = products(articles[0].part(at, rows[-1] + 1).ones(), articles[1].ones())
                    art = shares(articles[0].part(at, rows[-1] + 1), articles[1], both)
                    wanted |= (both > 0) & near[of][:, two.kind] if least > 0 else both > 0
                p, q = np.divmod(np.flatnonzero(wanted), len(two.kind))
                pair = of[p] * width + two.kind[q]
                found = [art[p, q] if shared else np.zeros(len(p)), *(m.ravel()[pair] for m in (ent, src, *([key] if scored else [])))]
                if able and shared:
                    may = _able(*found, 1.0)
                    p, q, found = p[may], q[may], [v[may] for v in found]
                if not len(p):
                    continue
                if scored:  # idf 1 of grams in both and 1 + ln 1.5 of others
                    a, b = grams[0].part(at, rows[-1] + 1), grams[1]
                    if able:
                        dot, in_a, in_b = some_common(a, b, p, q)
                    else:
                        dot, in_a, in_b = all_products(a, b, [(1, 1), (2, 0), (0, 2)], COMMON_GRAMS)[:, p, q]
                    norm = [v + c2 * (n - v) for v, n in ((in_a, one.squares[p + at]), (in_b, two.squares[q]))]
                    found.append(np.divide(dot, np.sqrt(norm[0] * norm[1]), out=np.zeros(len(p)), where=dot > 0))
                    if able:
                        may = _able(*found)
                        p, q, found = p[may], q[may], [v[may] for v in found]
                for n in range(0, len(p), OUT_ROWS):
                    part = slice(n, n + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(p[part] + at)), ids[1].take(pa.array(q[part])), *(pa.array(v[part]) for v in found)], names=names)

    types = [df.schema["cluster_id"].dataType.simpleString() for df in sides]
    return meet(*dealt, run, f"new_id {types[0]}, old_id {types[1]}, " + ", ".join(f"{n} double" for n in names[2:]), opened=_profiles)


def overlaps(new: DataFrame, existing: DataFrame, least: float = 0.0) -> DataFrame:
    """new_id, old_id, art, ent, src of profile pairs that share an article or entity, or, with least, of those
    whose entities overlap by that much."""
    return _profile_pairs(new, existing, least, False)


def duplicate_pairs(new: DataFrame, existing: DataFrame, scored: bool = True) -> DataFrame:
    """new_id, old_id, the five signals, blend and duplicate.

    Whatever the other signals, the blend stays below its threshold unless the entities overlap by .3 or more, so only such
    pairs are scored. scored=False keeps all duplicates and leaves out others: titles are compared only where they can decide.
    """
    strong = F.col("key") > STRONG
    least = F.when(strong, STRONG_LEAST).otherwise(LEAST)
    blend = F.when(strong, 0.05 * F.col("art") + 0.5 * F.col("ent") + TITLES * F.col("ttl") + 0.05 * F.col("src") + 0.1 * F.col("key")).otherwise(0.2 * F.col("art") + 0.4 * F.col("ent") + TITLES * F.col("ttl") + 0.1 * F.col("src"))
    rows = _profile_pairs(new, existing, 0.3, True, able=not scored)
    return rows.withColumn("blend", rounded(blend)).withColumn("duplicate", F.col("blend") >= least)


def merge_clusters(new: DataFrame, duplicates: DataFrame) -> DataFrame:
    """cluster_id, target (the first existing duplicate, else itself), merged."""
    first = duplicates.where("duplicate").groupBy(F.col("new_id").alias("cluster_id")).agg(F.min("old_id").alias("target"))
    return new.select("cluster_id").join(first, "cluster_id", "left").select("cluster_id", F.coalesce("target", "cluster_id").alias("target"), F.col("target").isNotNull().alias("merged"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """clusters created, merged into existing ones, and so prevented as duplicates (merged: cluster_id, target, merged)."""
    n = F.count_if("merged")
    return merged.agg(F.count_if(~F.col("merged")).alias("created"), n.alias("merged"), n.alias("prevented"))


def run_counts(articles: DataFrame, labels: DataFrame, merged: DataFrame) -> DataFrame:
    """articles of a run, those assigned to a valid cluster, and F20's counts."""
    assigned = labels.agg(F.count_distinct("id").alias("assigned"), F.count_distinct("label").alias("clusters"))
    return articles.agg(F.count(F.lit(1)).alias("processed")).crossJoin(F.broadcast(assigned)).crossJoin(F.broadcast(merge_counts(merged)))  # one row each


def write_members(members: DataFrame, added: DataFrame, clusters: DataFrame, updated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with new pairs (existing ones stay), clusters with the greater coherence."""
    return upsert(members, added, ["cluster_id", "article_id"], "keep"), upsert(clusters, updated, ["cluster_id"], "greatest")


def title_keywords(members: DataFrame, articles: DataFrame, k: int = 3) -> DataFrame:
    """the k words of a cluster's titles (more than 3 letters) with the highest summed TF-IDF."""
    rows = members.select("cluster_id", "article_id").join(articles.select("article_id", "title"), "article_id")
    n = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    words = rows.select("cluster_id", "article_id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))).alias("word"))
    tf = words.groupBy("cluster_id", "word").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("article_id").alias("df")).join(n, "cluster_id")
    score = F.round(F.col("tf") * (F.log((F.lit(1.0) + F.col("n")) / (1 + F.col("df"))) + 1), 6)
    return top_k(tf.select("cluster_id", "word", score.alias("score")), ["cluster_id"], [F.desc("score"), "word"], k)


#: Categories that name a cluster, by priority.
NAMING = ["apt_group", "ransomware_group", "malware_family", "vulnerability", "campaign", "company"]


def name_clusters(members: DataFrame, articles: DataFrame, hits: DataFrame, least: int = 70) -> DataFrame:
    """cluster_id, name: up to 3 heavy entities by category priority (2 a category), title words if there are fewer than 2, joined."""
    place = F.array_position(F.array(*map(F.lit, NAMING)), F.col("category"))
    rows = members.select("cluster_id", "article_id").join(hits.where(F.col("weight") >= least).select("article_id", "name", "category"), "article_id").withColumn("p", place.cast("int")).where("p > 0")
    counted = rows.groupBy("cluster_id", "p", "name").agg(F.count(F.lit(1)).alias("n"))
    two = top_k(counted, ["cluster_id", "p"], [F.desc("n"), "name"], 2).drop("rn")
    three = top_k(two, ["cluster_id"], ["p", F.desc("n"), "name"], 3).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names"))
    words = title_keywords(members, articles).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]).alias("words"))
    none = F.array().cast("array<string>")
    both = members.select("cluster_id").distinct().join(three, "cluster_id", "left").join(words, "cluster_id", "left").select("cluster_id", F.coalesce("names", none).alias("names"), F.coalesce("words", none).alias("words"))
    parts = F.when(F.size("names") >= 2, F.col("names")).otherwise(F.concat("names", "words"))
    return both.select("cluster_id", F.left(F.when(F.size(parts) > 0, F.array_join(parts, " - ")).otherwise(F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))), F.lit(200)).alias("name"))


def cluster_summary(members: DataFrame, articles: DataFrame) -> DataFrame:
    """the primary article's title and first 500 characters."""
    rows = members.where("is_primary").join(articles.select("article_id", "title", "content"), "article_id")
    return rows.select("cluster_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.left(F.coalesce("content", F.lit("")), F.lit(500)), F.lit("...")).alias("summary"))


def run_clustering(vec: DataFrame, dates: DataFrame, as_of: str, hours: int, threshold: float, mode: str = "incremental", most: int = 25) -> DataFrame:
    """label, id, similarity of the valid clusters of the window (four windows in full mode)."""
    recent = dates.where(F.col("published_at") >= since(as_of, hours * (4 if mode == "full" else 1)))
    rows = vec.join(recent.select("id"), "id", "left_semi")
    labels = materialize(cluster_articles(rows, threshold), "clusters")
    good = valid_clusters(labels, recent, rows, most=most, hours=hours, threshold=threshold)
    return member_similarity(labels.join(good.select("label"), "label", "left_semi").select("id", "label"), rows)


def window_rank(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
