"""Structured Streaming forms of ingest, trending, membership and follows.

Every function takes and gives a streaming DataFrame, or starts no query of its own except where it says so; ``drain``
runs one over what there is and gives what its sink holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..operators import feeds as O
from ..operators import vectors as V
from ..sources.shared import materialize, shared_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", prepare: Callable | None = None) -> DataFrame:
    """Run a stream over all that its source has (availableNow) into a table in the shared folder; in update mode the rows
    of all batches, with their batch number."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/threatloom-stream-{uuid.uuid4().hex}"
    schema = stream.schema.add("batch", LongType()) if mode != "append" else stream.schema

    def put(df: DataFrame, batch: int) -> None:
        rows = prepare(df) if prepare else df
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/out/b={batch}")  # a repeated batch replaces itself

    if mode == "append" and prepare is None:
        query = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        query = stream.writeStream.foreachBatch(put)
    query.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out" if mode == "append" and prepare is None else f"{base}/out/*")


def stream_ingest(items: DataFrame, domains: list[str], lateness: str = "7 days") -> DataFrame:
    """Relevant items of a stream (title, description, link, published_at, feed_category), each link once."""
    rows = O.drop_title_patterns(O.drop_excluded_domains(items, domains))
    rows = O.security_relevant(O.scored(rows)).where("relevant")
    return rows.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["link"])


def ingest_batches(items: DataFrame, domains: list[str], stored: DataFrame, base: str, lateness: str = "7 days", trigger: dict | None = None) -> DataFrame:
    """J1 as a job of its own: what stream_ingest gives, without links that are stored (link) or that an earlier batch wrote; the
    table of all batches. base: the caller's folder for output and checkpoint; a stream that restarts there goes on, and a
    repeated batch replaces what it wrote.
    """
    spark, rows = items.sparkSession, stream_ingest(items, domains, lateness)
    written = f"{base}/out"
    _init(spark.createDataFrame([], rows.schema), written)

    def put(df: DataFrame, batch: int) -> None:
        earlier = spark.read.schema(_parts(df.schema)).parquet(written).where(F.col("b") < batch).select("link")
        fresh = df.join(stored.select("link"), "link", "left_anti").join(earlier, "link", "left_anti").select(df.columns)
        fresh.write.mode("overwrite").parquet(f"{written}/b={batch}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(_parts(rows.schema)).parquet(written).drop("b")


def _parts(schema: StructType) -> StructType:
    """The schema of a table whose parts are batches."""
    return StructType([*schema.fields, StructField("b", LongType())])


def _init(empty: DataFrame, path: str) -> None:
    """An empty first part of a table whose parts are batches, if it isn't there."""
    empty.write.mode("ignore").parquet(f"{path}/b=-1")


def route_late(items: DataFrame, as_of: str, hours: int, base: str, sinks: dict[str, Callable[[DataFrame, str], None]] | None = None, trigger: dict | None = None) -> DataFrame:
    """Items of the window and items past it in two tables, kept and late; sink, b (batch), n of what was written.

    Both parts of a batch are written under its number, so a batch that fails between its sinks is repeated and replaces its
    parts: nothing is lost or doubled. sinks: other writers by name, of (rows, path).
    """
    spark = items.sparkSession
    write = {n: (sinks or {}).get(n, lambda df, path: df.write.mode("overwrite").parquet(path)) for n in ("kept", "late")}
    for name in write:
        _init(spark.createDataFrame([], items.schema), f"{base}/{name}")

    def put(df: DataFrame, batch: int) -> None:
        batch_rows = df.persist()
        try:
            for name, part in zip(write, split_late(batch_rows, as_of, hours), strict=True):
                write[name](part, f"{base}/{name}/b={batch}")
        finally:
            batch_rows.unpersist()

    items.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    part = lambda n: spark.read.schema(_parts(items.schema)).parquet(f"{base}/{n}").where("b >= 0").groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sink"), "b", "n")
    return part("kept").unionByName(part("late"))


def split_late(batch: DataFrame, as_of: str, hours: int) -> tuple[DataFrame, DataFrame]:
    """(items of the window, items past it) of a micro-batch, for a foreachBatch with two sinks."""
    late = F.col("published_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return batch.where(~late), batch.where(late)


def stream_trending(hits: DataFrame, lateness: str = "1 hour", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Hits (name, article_id, at) per name and sliding window: mentions and approximate distinct articles.

    Each event is counted once, in a pane as long as the slide, with a sketch of its articles; a second aggregation adds up the
    panes of each window and merges their sketches, so state holds a row a name and pane, not one for each window of each event.
    """
    panes = hits.withWatermark("at", lateness).groupBy(F.window("at", slide).alias("pane"), "name").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("article_id", F.lit(14)).alias("seen"))
    windows = panes.groupBy(F.window(F.window_time("pane"), length, slide).alias("w"), "name")
    return windows.agg(F.sum("n").alias("mentions"), F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("articles"))


def stream_membership(changes: DataFrame) -> DataFrame:
    """article_count and last change of each cluster (update mode)."""
    return changes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"), F.max("added_at").alias("last_modified"))


class _Marks(StatefulProcessor):
    """Keeps each (user, cluster)'s mark and gives the articles newer than it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", StructType([StructField("at", TimestampType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        last, out = mark, []
        for f in rows:
            start = f.start_at.min() if mark is None else pd.Timestamp(mark)
            new = f[f.added_at > start]
            if len(new):
                last = new.added_at.max() if last is None else max(pd.Timestamp(last), new.added_at.max())
                out.append(new)
        if last is not None:
            self.mark.update((pd.Timestamp(last).to_pydatetime(),))
        for new in out:
            yield pd.DataFrame({"user_id": new.user_id, "cluster_id": new.cluster_id, "article_id": new.article_id})

    def close(self) -> None:
        pass


def stream_follow(changes: DataFrame, follows: DataFrame) -> DataFrame:
    """user_id, cluster_id, article_id of additions (cluster_id, article_id, added_at) newer than the follower's mark, which
    then moves. Needs the RocksDB state store."""
    rows = changes.join(follows.where("notify").select("user_id", "cluster_id", F.col("created_at").alias("start_at")), "cluster_id").select("user_id", "cluster_id", "article_id", "added_at", "start_at")
    return rows.groupBy("user_id", "cluster_id").transformWithStateInPandas(_Marks(), "user_id long, cluster_id long, article_id long", "append", "None")


def stream_status(rows: DataFrame, at: str, lateness: str = "1 hour") -> DataFrame:
    """Volume per hour and stage (rows: stage, at)."""
    return rows.withWatermark(at, lateness).groupBy(F.window(at, "1 hour").alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"))


def stream_cluster(vectors: DataFrame, threshold: float, min_samples: int = 2, trigger: dict | None = None, base: str | None = None) -> DataFrame:
    """Id, label of all batches of a stream of vectors (id, vec). Each micro-batch goes to the stored clusters first (F6: the
    nearest representative at the threshold), the rest is clustered (F7), and new clusters store their least member as
    representative. A repeated batch sees the representatives of earlier batches only, and replaces what it had written.

    base: the caller's folder for labels, representatives and checkpoint; a stream that restarts there goes on with all
    clusters of before. By default a new folder.
    """
    spark = vectors.sparkSession
    base = base or f"{shared_dir(spark)}/threatloom-stream-{uuid.uuid4().hex}"
    kept, out = "cluster_id long, vec array<double>", "id long, label long"
    _init(spark.createDataFrame([], kept), f"{base}/reps")
    _init(spark.createDataFrame([], out), f"{base}/out")

    def put(df: DataFrame, batch: int) -> None:
        rows = materialize(df.select("id", F.col("vec").cast("array<double>").alias("vec")), "batch")
        old = spark.read.schema(f"{kept}, b long").parquet(f"{base}/reps").where(F.col("b") < batch)
        near = materialize(V.assign_nearest(rows, old.select("cluster_id", "vec"), threshold), "near")
        rest = materialize(rows.join(near.select("id"), "id", "left_anti"), "rest")
        fresh = materialize(V.dbscan_vectors(rest, threshold, min_samples), "fresh")
        near.select("id", F.col("cluster_id").alias("label")).unionByName(fresh.select("id", "label")).write.mode("overwrite").parquet(f"{base}/out/b={batch}")
        first = fresh.groupBy("label").agg(F.min("id").alias("id"))
        first.join(rest, "id").select(F.col("label").alias("cluster_id"), "vec").write.mode("overwrite").parquet(f"{base}/reps/b={batch}")

    query = vectors.select("id", "vec").writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(f"{out}, b long").parquet(f"{base}/out").select("id", "label")
