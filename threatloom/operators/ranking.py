"""Scores and rankings of articles and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.upsert import upsert

# The weights of the four factors as shipped.
WEIGHTS = {"recency_score": 0.30, "source_credibility": 0.20, "entity_importance": 0.20, "keyword_severity": 0.30}


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounded half up, ties being told after a first rounding to six digits more."""
    return F.floor(F.round(value * 10**digits, 6) + 0.5) / 10**digits


def to_rank(articles: DataFrame, members: DataFrame, rankings: DataFrame, as_of: str, hours: int, all_unranked: bool = False) -> DataFrame:
    """G1: articles of the window (or all that have no ranking) with their cluster, the least id of several."""
    if all_unranked:
        rows = articles.join(rankings.select("article_id").distinct(), "article_id", "left_anti")
    else:
        rows = articles.where(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return rows.join(members.groupBy("article_id").agg(F.min("cluster_id").alias("cluster_id")), "article_id", "left")


def recency_score(published: Column, as_of: str, decay_hours: float = 24.0) -> Column:
    """100 at age 0 or less, 0 from the decay on, linear between; 0 of a null."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9
    return F.when(published.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - age / decay_hours)))).otherwise(0.0)


def source_score(credibility: Column) -> Column:
    """Credibility within 0 to 100; 50 of a null."""
    return F.when(credibility.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), credibility))).otherwise(50).cast("double")


def entity_score(hits: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per article the mean weight (50 of unknown entities), plus 5 for each of 3 or more entities of weight 80 (20 at most),
    100 at most; the entities of weight 70 or more with category and weight."""
    table = dictionary.groupBy("category", "name").agg(F.max("weight").alias("__w"))
    rows = hits.select("article_id", "name", "category").join(table, ["category", "name"], "left").withColumn("w", F.coalesce("__w", F.lit(50)))
    strong = F.count_if(F.col("w") >= 80)
    mean = F.avg("w")
    return rows.groupBy("article_id").agg(
        F.round(F.when(strong >= 3, F.least(F.lit(100.0), mean + F.least(F.lit(20), 5 * strong))).otherwise(mean), 6).alias("entity_importance"),
        F.count(F.lit(1)).alias("entity_count"),
        F.sort_array(F.collect_set(F.when(F.col("w") >= 70, F.struct("name", "category", "w")))).alias("contributing"),
    )


def keyword_variants(rules: DataFrame) -> DataFrame:
    """Each keyword, lower case, also with blanks for ``_`` and for ``-``; the last rule of a variant wins."""
    low = F.lower("keyword")
    rows = rules.select("rule_no", "category", "weight", F.explode(F.array_distinct(F.array(low, F.replace(low, F.lit("_"), F.lit(" ")), F.replace(low, F.lit("-"), F.lit(" "))))).alias("variant"))
    return rows.groupBy("variant").agg(F.max_by(F.struct("rule_no", "category", "weight"), "rule_no").alias("r")).select("variant", "r.*")


def keyword_score(articles: DataFrame, variants: DataFrame, top: int = 5) -> DataFrame:
    """article_id, keyword_severity, matches. A variant in the title counts twice its weight, in the content once; the
    best ``top`` hits, in the order of points and rules, give sum / (200 * hits) * 100.

    The rules are a small fixed table: they become an array literal, so each article is scored where it is, without a
    join or a shuffle.
    """
    rules = sorted((r["rule_no"], r["variant"], r["weight"]) for r in variants.collect())
    title, content = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    cells = [
        F.struct(F.when(title.contains(v), -2 * w).when(content.contains(v), -w).alias("points"), F.lit(n).alias("rule_no"), F.lit(v).alias("variant")) for n, v, w in rules
    ]
    best = F.slice(F.array_sort(F.filter(F.array(*cells), lambda x: x["points"].isNotNull())), 1, top)
    rows = articles.select("article_id", best.alias("__b"))
    total = F.aggregate("__b", F.lit(0), lambda a, x: a - x["points"])
    score = F.when(F.size("__b") > 0, F.round(total / (200 * F.size("__b")) * 100, 6)).otherwise(0.0)
    return rows.select("article_id", score.alias("keyword_severity"), F.transform("__b", lambda x: x["variant"]).alias("matches"))


def article_score(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The weighted sum of the factors (weights are normalised unless they add up to 1 within .01), 0 to 100, one decimal."""
    total = sum(weights.values())
    scale = 1.0 if abs(total - 1) <= 0.01 else 1.0 / total
    value = None
    for c, w in weights.items():
        part = F.coalesce(c, F.lit(0.0)) * (w * scale)
        value = part if value is None else value + part
    return df.withColumn("score", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 1))


def write_rankings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rankings with the new ones in place of their articles'; scores are cut to integers; of an article in several
    clusters the least cluster stays."""
    one = new.groupBy("article_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "article_id"]), "cluster_id").alias("__one")).select("article_id", "__one.*")
    return upsert(old, one.withColumn("score", F.col("score").cast("int")), ["article_id"], "replace")


def cluster_score(members: DataFrame, rankings: DataFrame, clusters: DataFrame) -> DataFrame:
    """.7 of the mean score plus 30 times the coherence; 5 articles or more add min(10, n); 100 at most, one decimal."""
    rows = members.join(rankings.select("article_id", "score"), "article_id").groupBy("cluster_id").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    base = F.col("mean") * 0.7 + F.col("coherence") * 30
    return rows.join(clusters.select("cluster_id", "coherence"), "cluster_id").select(
        "cluster_id", "n", half_up(F.when(F.col("n") >= 5, F.least(F.lit(100.0), base + F.least(F.lit(10), F.col("n")))).otherwise(base), 1).alias("score")
    )


def cluster_rankings(clusters: DataFrame, rankings: DataFrame) -> DataFrame:
    """Active clusters with their number of ranked articles, mean score (two decimals) and rounded cluster score."""
    rows = clusters.where("is_active").join(rankings.select("cluster_id", "score"), "cluster_id").groupBy("cluster_id", "name", "coherence").agg(F.count(F.lit(1)).alias("articles"), F.avg("score").alias("mean"))
    return rows.select("cluster_id", "name", "articles", half_up(F.col("mean"), 2).alias("avg_score"), half_up(F.col("mean") * 0.7 + F.col("coherence") * 30).cast("int").alias("cluster_score"))


def articles_with_rankings(articles: DataFrame, feeds: DataFrame, rankings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ranked articles with feed, factors and, if any, their cluster's name."""
    rows = articles.join(feeds.select("feed_id", F.col("name").alias("feed_name"), "credibility"), "feed_id").join(rankings, "article_id")
    return rows.join(clusters.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id", "left").select(
        "article_id", "title", "feed_name", "credibility", "score", "recency_score", "source_credibility", "entity_importance", "keyword_severity", "cluster_name"
    )


def score_distribution(rankings: DataFrame) -> DataFrame:
    """Count, mean, least, largest, deviation and the four bands."""
    s = F.col("score")
    return rankings.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.stddev_samp(s), 6).alias("deviation"),
        F.count_if(s >= 90).alias("critical"), F.count_if(s.between(70, 89)).alias("high"), F.count_if(s.between(50, 69)).alias("medium"), F.count_if(s < 50).alias("low"),
    )


def ranking_stats(rankings: DataFrame) -> DataFrame:
    """Mean score and factors, clusters touched."""
    return rankings.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("score", *WEIGHTS)), F.count_distinct("cluster_id").alias("clusters"))
