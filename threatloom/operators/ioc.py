"""Indicator feeds: parsing, validation and corroboration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources.upsert import upsert
from .entities import outside


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of feed files: feed (file name), line_no (by place in the file), line. A file is read whole, so it is for
    feeds, which are small files; large tables of lines come with their own numbers."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("feed"), F.split("value", "\r?\n").alias("l"))
    return files.select("feed", F.posexplode("l").alias("line_no", "line"))


def _fits(indicator: Column, kind: Column, expected: str) -> Column:
    shape = {
        "ip_address": indicator.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"),
        "domain": indicator.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9-_.]*[a-zA-Z0-9]\.[a-zA-Z]{2,}$"),
        "file_hash": indicator.rlike(r"^(?:[A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})$"),
    }[expected]
    return F.when(kind == "", shape).otherwise(kind.isin(R.INTEL_TYPES[expected]))


def read_tab_intel(lines: DataFrame, ioc_type: str) -> DataFrame:
    """A5: feed, ioc of the tab-separated lines behind each feed's ``#fields`` header whose type fits the feed's.

    Headers are at most one row a feed, found by an aggregation and joined back.
    """
    header = lines.where(F.col("line").startswith("#fields")).groupBy("feed").agg(F.min("line_no").alias("__header"))
    rows = lines.join(header, "feed").where("line_no > __header").withColumn("line", F.trim("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    cells = F.split("line", "\t")
    indicator, kind = F.trim(F.get(cells, F.lit(0))), F.trim(F.coalesce(F.get(cells, F.lit(1)), F.lit("")))
    return rows.where(_fits(indicator, kind, ioc_type) & (indicator != "")).select("feed", indicator.alias("ioc"), F.lit(ioc_type).alias("ioc_type"))


def read_plain_intel(lines: DataFrame, ioc_type: str) -> DataFrame:
    """Feed, ioc of one-per-line feeds: the first blank-, then comma-separated token without quotes."""
    text = F.trim("line")
    token = F.regexp_replace(F.get(F.split(F.get(F.split(text, r"\s+"), F.lit(0)), ","), F.lit(0)), "[\"']", "")
    rows = lines.where((text != "") & ~text.startswith("#") & ~text.startswith("//"))
    return rows.select("feed", F.trim(token).alias("ioc"), F.lit(ioc_type).alias("ioc_type")).where("ioc <> ''")


def normalise(ioc: Column, ioc_type: Column) -> Column:
    """The normal form of an indicator, or null if it is not valid."""
    raw = F.trim(F.coalesce(ioc, F.lit("")))
    ip = F.when(outside(raw, R.IOC_NETWORKS), raw)
    bare = F.regexp_replace(F.lower(raw), "^https?://", "")
    domain = F.get(F.split(F.get(F.split(bare, "/"), F.lit(0)), ":"), F.lit(0))
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    good = (
        domain.rlike(rf"^{label}(?:\.{label})+$")
        & (F.length(domain) >= 3)
        & ~domain.isin(R.IOC_DOMAINS)
        & ~F.regexp_extract(domain, r"([^.]+)$", 1).isin(R.IOC_TLDS)
        & ~domain.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    )
    up = F.upper(raw)
    digest = F.when(up.rlike("^(?:[A-F0-9]{32}|[A-F0-9]{40}|[A-F0-9]{64})$") & ~up.rlike("^(?:0+|F+)$"), up)
    return F.when(ioc_type == "ip_address", ip).when(ioc_type == "domain", F.when(good, domain)).when(ioc_type == "file_hash", digest)


def validate_iocs(iocs: DataFrame) -> DataFrame:
    """Valid indicators in their normal form."""
    return iocs.withColumn("ioc", normalise(F.col("ioc"), F.col("ioc_type"))).where("ioc IS NOT NULL")


def dedup_iocs(iocs: DataFrame) -> DataFrame:
    """Each normal form once per feed."""
    return iocs.dropDuplicates(["feed", "ioc_type", "ioc"])


def corroborate(iocs: DataFrame, min_feeds: int = 1) -> DataFrame:
    """D3: the sorted feeds of each indicator that at least min_feeds carry."""
    rows = iocs.groupBy("ioc_type", "ioc").agg(F.sort_array(F.collect_set("feed")).alias("feeds"))
    return rows.where(F.size("feeds") >= min_feeds)


def ioc_importance(rows: DataFrame) -> DataFrame:
    """Weight 75, 65 or 50 by the number of feeds (4, 3, fewer)."""
    n = F.size("feeds")
    return rows.withColumn("weight", F.when(n >= 4, 75).when(n == 3, 65).otherwise(50))


def merge_iocs(dictionary: DataFrame, iocs: DataFrame, source: str = "ioc_feeds") -> DataFrame:
    """Dictionary (name, category, weight, source, feeds) with the indicators' weight, source and feeds over it."""
    new = iocs.select(F.col("ioc").alias("name"), F.col("ioc_type").alias("category"), "weight", F.lit(source).alias("source"), "feeds")
    return upsert(dictionary.select("name", "category", "weight", "source", "feeds"), new, ["name", "category"], "overwrite")


def ioc_run_stats(fetched: DataFrame, validated: DataFrame, stored: DataFrame, fetches: DataFrame) -> DataFrame:
    """Fetched, validated and stored indicators, feeds processed and failed, per type and in all (null type).

    fetches: ioc_type, feed, error (null: read) of each feed of the run.
    """
    names = ["fetched", "validated", "stored", "feeds_processed", "feeds_failed"]
    marks = [(fetched, "fetched"), (validated, "validated"), (stored, "stored"), (fetches.where("error IS NULL"), "feeds_processed"), (fetches.where("error IS NOT NULL"), "feeds_failed")]
    parts = [df.select("ioc_type", *(F.lit(int(n == name)).alias(n) for n in names)) for df, name in marks]
    return reduce(DataFrame.unionByName, parts).rollup("ioc_type").agg(*(F.sum(n).alias(n) for n in names))


def ioc_inventory(iocs: DataFrame, k: int = 10) -> DataFrame:
    """Counts by category, in all, and of the k feeds with most indicators, as (kind, name, n)."""
    by_type = iocs.rollup("ioc_type").agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("ioc_type").isNull(), "total").otherwise("category").alias("kind"), F.coalesce("ioc_type", F.lit("all")).alias("name"), "n")
    feeds = iocs.select(F.explode("feeds").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(k)
    return by_type.unionByName(feeds.select(F.lit("feed").alias("kind"), "name", "n"))
