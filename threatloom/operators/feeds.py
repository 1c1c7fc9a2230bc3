"""Feed entries: sources, publication dates, relevance scores and ingest counters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """A1: items of XML feed files as title, link, description, pub_date; rows lacking title or link are dropped."""
    schema = "title string, link string, description string, pubDate string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return clean_entries(items.withColumnRenamed("pubDate", "pub_date"))


def clean_entries(items: DataFrame) -> DataFrame:
    """A1: trimmed entries that have a title and a link."""
    trimmed = items.withColumns({c: F.trim(c) for c in ("title", "link", "description", "pub_date") if c in items.columns})
    return trimmed.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))


def load_feed_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A2: existing feeds plus those whose url is new (credibility 50 and active by default)."""
    fresh = incoming.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti")
    fresh = fresh.withColumns({"credibility": F.coalesce("credibility", F.lit(50)), "is_active": F.coalesce("is_active", F.lit(True))})
    return existing.unionByName(fresh.select(existing.columns))


def active_feeds(feeds: DataFrame) -> DataFrame:
    """A3: active feeds, the most credible first."""
    return feeds.where("is_active").orderBy(F.desc("credibility"), "feed_id")


def with_published(df: DataFrame, as_of: str, text: str = "pub_date") -> DataFrame:
    """B1: published_at from RFC 2822, else ISO with 0 to 6 fractional digits, else as_of (UTC)."""
    bare = F.regexp_replace(F.trim(F.col(text)), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    tries = [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    iso = F.col(text).try_cast("timestamp") if hasattr(Column, "try_cast") else F.try_to_timestamp(text)
    return df.withColumn("published_at", F.coalesce(*tries, iso, F.lit(as_of).cast("timestamp")))


def within_window(df: DataFrame, as_of: str, hours: int = 168, at: str = "published_at") -> DataFrame:
    """B2: rows not older than the window."""
    return df.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def drop_excluded_domains(df: DataFrame, domains: list[str] = R.EXCLUDED_DOMAINS, link: str = "link") -> DataFrame:
    """Rows whose lower-cased link holds none of the domains as a substring."""
    return df.where(~_any_of(F.lower(F.coalesce(link, F.lit(""))), domains))


def drop_title_patterns(df: DataFrame, patterns: list[str] = R.TITLE_PATTERNS, title: str = "title") -> DataFrame:
    """Rows whose lower-cased title matches none of the patterns at its start."""
    one = "^(?:" + "|".join(p.lstrip("^") for p in patterns) + ")"
    return df.where(~F.lower(F.coalesce(title, F.lit(""))).rlike(one))


def _any_of(text: Column, terms: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, terms)))


def _points(pairs: list[tuple[str, float]]) -> Column:
    """A map of each term to the sum of its points."""
    sums: dict[str, float] = {}
    for term, n in pairs:
        sums[term] = sums.get(term, 0) + n
    return F.create_map(*(F.lit(x) for pair in sums.items() for x in pair))


def _total(terms: Column, points: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.coalesce(F.element_at(points, t), F.lit(0)))


def _has(terms: Column, some: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, some)))


#: Every term of the three scores, once.
TERMS = list(dict.fromkeys([t for _, _, ts in R.POSITIVE for t in ts] + R.ACTION_VERBS + [t for *_, ts in R.NEGATIVE for t in ts] + R.MISLEADING[1] + R.MISLEADING_GUARD + [t for p, unless in R.UNLESS for t in (p, *unless)]))


def positive_score(terms: Column, head: Column, text: Column) -> Column:
    """Keyword scores (twice in a title), action verbs, technical patterns; times 1.5, cut, with three keywords or more.

    terms: those of TERMS in the lower-cased title and body (text); head: those in the title.
    """
    keywords = [(t, s) for _, s, ts in R.POSITIVE for t in ts]
    score = _total(terms, _points([*keywords, *((v, R.ACTION_SCORE) for v in R.ACTION_VERBS)])) + _total(head, _points(keywords))
    found = _total(terms, _points([(t, 1) for t, _ in keywords]))
    total = reduce(lambda x, y: x + y, [F.when(text.rlike(p), s).otherwise(0) for p, s in R.TECHNICAL], score)
    return F.when(found >= R.MANY_KEYWORDS, F.floor(total * R.MANY_FACTOR)).otherwise(total).cast("int")


def negative_score(terms: Column, head: Column) -> Column:
    """Commerce, consumer and review terms (the strong ones 1.5 times in a title), misleading terms without a threat word."""
    points, misleading = [(t, s) for s, _, ts in R.NEGATIVE for t in ts], _points([(t, R.MISLEADING[0]) for t in R.MISLEADING[1]])
    more = _points([(t, int(s * R.TITLE_PENALTY) - s) for s, strong, ts in R.NEGATIVE if strong for t in ts])
    unguarded = F.when(_has(terms, R.MISLEADING_GUARD), 0).otherwise(_total(terms, misleading))
    return (_total(terms, _points(points)) + _total(head, more) + unguarded).cast("int")


def exclusion_penalty(terms: Column) -> Column:
    """20 for each pattern that is present with none of its "unless" words."""
    parts = [F.when(F.array_contains(terms, p) & ~_has(terms, unless), R.UNLESS_SCORE).otherwise(0) for p, unless in R.UNLESS]
    return reduce(lambda x, y: x + y, parts).cast("int")


def scored(df: DataFrame, title: str = "title", body: str = "description") -> DataFrame:
    """Positive, negative, penalty and score (their balance). Each term is looked for once in each text."""
    head, text = F.col("__head"), F.col("__text")
    rows = df.withColumn("__head", F.lower(F.coalesce(title, F.lit(""))))
    rows = rows.withColumn("__text", F.concat(head, F.lit(" "), F.lower(F.coalesce(body, F.lit("")))))
    rows = rows.withColumn("__terms", F.filter(F.array(*map(F.lit, TERMS)), lambda t: text.contains(t)))
    rows = rows.withColumn("__own", F.filter("__terms", lambda t: head.contains(t)))
    terms, own = F.col("__terms"), F.col("__own")
    rows = rows.withColumns({"positive": positive_score(terms, own, text), "negative": negative_score(terms, own), "penalty": exclusion_penalty(terms)})
    return rows.withColumn("score", F.col("positive") - F.col("negative") - F.col("penalty")).drop("__head", "__text", "__terms", "__own")


def security_relevant(df: DataFrame, category: str = "feed_category") -> DataFrame:
    """``relevant``: the score reaches its feed category's threshold."""
    least = F.lit(R.DEFAULT_THRESHOLD)
    for name, value in R.THRESHOLDS.items():
        least = F.when(F.col(category) == name, value).otherwise(least)
    return df.withColumn("relevant", F.col("score") >= least)


def new_links(batch: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """The first item (by order) of each link that history lacks."""
    fresh = batch.join(history.select("link").distinct(), "link", "left_anti")
    first = fresh.groupBy("link").agg(F.min_by(F.struct(*fresh.columns), order).alias("r"))
    return first.select("r.*").select(batch.columns)


def ingest_stats(dispositions: DataFrame) -> DataFrame:
    """Per feed and in all (null feed): fetched, too_old, filtered, stored, duplicate; one pass over ``disposition``."""
    count = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return dispositions.rollup("feed").agg(F.count(F.lit(1)).alias("fetched"), *(count(d) for d in ("too_old", "filtered", "stored", "duplicate")))
