"""Pending work and keyed upserts over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def pending(df: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows that a stage has not done, the newest first."""
    rows = df.join(done.select(key).distinct(), key, "left_anti").orderBy(F.desc(order), key)
    return rows if limit is None else rows.limit(limit)


def pending_counts(stages: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """A10: stage and number of rows that wait; stages: name -> (input, output, key)."""
    parts = [a.join(b.select(k).distinct(), k, "left_anti").agg(F.count(F.lit(1)).alias("waiting")).select(F.lit(n).alias("stage"), "waiting") for n, (a, b, k) in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rule: str, columns: list[str] | None = None) -> DataFrame:
    """Target with updates by key. Rules: ``keep`` (and ``insert``): existing rows win; ``overwrite``: the updates'
    values of ``columns`` (all by default) win; ``greatest``: the greater value; ``replace``: rows of updated keys go.

    Updates must be unique by key. Rows meet in one full outer join on the keys.
    """
    if rule in ("keep", "insert"):
        return target.unionByName(updates.join(target.select(keys), keys, "left_anti").select(target.columns))
    if rule == "replace":
        return target.join(updates.select(keys).distinct(), keys, "left_anti").select(target.columns).unionByName(updates.select(target.columns))
    if rule not in ("overwrite", "greatest"):
        raise ValueError(f"no such rule: {rule}")
    set_ = columns or [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in target.columns if c not in keys), F.lit(True).alias("__new"))
    joined = target.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str):
        old, fresh = F.col(c), F.col(f"__{c}")
        if c not in set_:
            return F.when(F.col("__old"), old).otherwise(fresh)
        if rule == "greatest":
            return F.greatest(old, fresh)  # nulls don't count
        return F.when(F.col("__new"), fresh).otherwise(old)

    return joined.select(*(F.col(c) if c in keys else value(c).alias(c) for c in target.columns))


BUCKETS = 64


def bucketed(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A table in folders by a hash of its keys, for upsert_buckets."""
    bucketed(df, keys, buckets).repartition("__bucket").write.partitionBy("__bucket").mode("overwrite").parquet(path)


def upsert_buckets(path: str, updates: DataFrame, keys: list[str], rule: str, columns: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """A11 in place: upsert() on the buckets that updates touch; all others are neither read nor written. The number of
    touched buckets.

    The new buckets are written to the shared folder before they replace the old ones, so a job that fails before that leaves the
    table as it was.
    """
    spark = updates.sparkSession
    updates = materialize(bucketed(updates, keys, buckets), "updates")
    touched = [r[0] for r in updates.select("__bucket").distinct().collect()]  # a number a bucket
    if touched:
        target = spark.read.parquet(path).where(F.col("__bucket").isin(touched)).drop("__bucket")
        merged = materialize(bucketed(upsert(target, updates.drop("__bucket"), keys, rule, columns), keys, buckets), "upserted")
        merged.repartition("__bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").mode("overwrite").parquet(path)
    return len(touched)
