"""Follow and notification queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .reports import hits_of, since, top_k


def cluster_deltas(follows: DataFrame, members: DataFrame, as_of: str, k: int = 10) -> DataFrame:
    """Per (user, cluster) the newest k articles added after the last notice (else 7 days ago) and the follow's start.

    Each cluster's k newest articles are found first, whoever follows it; what a follower hasn't seen is the head of that list, so
    the join makes at most k rows a follow.
    """
    start = F.greatest(F.coalesce("last_notified_at", since(as_of, 168)), "created_at")
    mine = follows.where("notify").select("user_id", "cluster_id", start.alias("__start"))
    past = members.select("cluster_id", "article_id", "added_at").where(F.col("added_at") <= F.lit(as_of).cast("timestamp")).join(mine.select("cluster_id").distinct(), "cluster_id", "left_semi")
    newest = top_k(past, ["cluster_id"], [F.desc("added_at"), "article_id"], k)
    return mine.join(newest, "cluster_id").where(F.col("added_at") > F.col("__start")).select("user_id", "cluster_id", "article_id", "rn")


def cluster_header(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Name, creation time and number of distinct articles of each cluster."""
    n = members.groupBy("cluster_id").agg(F.count_distinct("article_id").alias("articles"))
    return clusters.join(n, "cluster_id", "left").select("cluster_id", "name", "created_at", F.coalesce("articles", F.lit(0)).alias("articles"))


def newest_by_entity(named: DataFrame, k: int) -> DataFrame:
    """The k newest articles of each entity (entity_id, article_id, published_at), ranked before the shuffle as well."""
    return top_k(named, ["entity_id"], [F.desc("published_at"), "article_id"], k).drop("rn")


def entity_deltas(follows: DataFrame, hits: DataFrame | Callable[[DataFrame], DataFrame], articles: DataFrame, as_of: str, k: int = 20) -> DataFrame:
    """Per (user, feed) the newest k articles since the feed's last activity (else 24 h ago) that name a followed entity,
    with the ids of all followed entities that they name.

    Only the newest k of a feed are wanted, so the newest k articles of each entity suffice: all before one of them in the feed's list
    that name the same entity are newer. Followers meet k rows an entity, however often it is named, and the k kept
    then look up every followed entity. hits: a table, or a function that makes the hits of given article ids.
    """
    mine = follows.where("notify")
    begin = materialize(mine.groupBy("user_id", "feed_id").agg(F.coalesce(F.max("last_activity"), since(as_of, 24)).alias("since")), "since")
    earliest = begin.agg(F.min("since")).first()[0]
    dates = articles.select("article_id", "published_at").where((F.col("published_at") > F.lit(earliest)) & (F.col("published_at") <= F.lit(as_of).cast("timestamp")))
    mine = mine.select("user_id", "feed_id", "entity_id").distinct()
    named = hits_of(hits, dates.select("article_id").distinct()).select("article_id", "entity_id").distinct()
    named = materialize(named.join(mine.select("entity_id").distinct(), "entity_id", "left_semi").join(dates, "article_id"), "named")
    rows = mine.join(newest_by_entity(named, k), "entity_id").join(begin, ["user_id", "feed_id"]).where(F.col("published_at") > F.col("since"))
    kept = top_k(rows.select("user_id", "feed_id", "article_id", "published_at").distinct(), ["user_id", "feed_id"], [F.desc("published_at"), "article_id"], k)
    ids = kept.join(named.select("article_id", "entity_id"), "article_id").join(mine, ["user_id", "feed_id", "entity_id"])
    return ids.groupBy("user_id", "feed_id", "article_id", "published_at", "rn").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def digest_by_entity(deltas: DataFrame, shown: int = 3) -> DataFrame:
    """I4: per (user, feed, entity) up to 3 articles and how many more there are."""
    rows = deltas.select("user_id", "feed_id", "article_id", "published_at", F.explode("entity_ids").alias("entity_id"))
    n = rows.groupBy("user_id", "feed_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(rows, ["user_id", "feed_id", "entity_id"], [F.desc("published_at"), "article_id"], shown)
    return best.join(n, ["user_id", "feed_id", "entity_id"]).select("user_id", "feed_id", "entity_id", "article_id", "rn", F.greatest(F.lit(0), F.col("n") - shown).alias("more"))


def advance_marks(follows: DataFrame, delivered: DataFrame, keys: list[str], mark: str, as_of: str) -> DataFrame:
    """The mark moves to as_of for delivered keys only."""
    rows = follows.join(delivered.select(*keys).distinct().withColumn("__d", F.lit(True)), keys, "left")
    return rows.withColumn(mark, F.when(F.col("__d"), F.lit(as_of).cast("timestamp")).otherwise(F.col(mark))).drop("__d")


def delivery_log(deltas: DataFrame, as_of: str) -> DataFrame:
    """One row for each (user, cluster) delivered: number of articles and status; append it to the log table."""
    return deltas.groupBy("user_id", "cluster_id").agg(F.count(F.lit(1)).alias("articles")).withColumns({"status": F.lit("sent"), "sent_at": F.lit(as_of).cast("timestamp")})


def audience(users: DataFrame, follows: DataFrame) -> DataFrame:
    """Active users with an address who opted in or follow something with notices."""
    some = follows.where("notify").select("user_id").distinct().withColumn("__f", F.lit(True))
    rows = users.where("is_active AND email IS NOT NULL AND email <> ''").join(some, "user_id", "left")
    return rows.where(F.col("daily_email") | F.coalesce("__f", F.lit(False))).select("user_id", "email")


def feeds_with_counts(follows: DataFrame) -> DataFrame:
    """I8: distinct followed entities of each personal feed."""
    return follows.groupBy("user_id", "feed_id").agg(F.count_distinct("entity_id").alias("entities"))


def most_followed(follows: DataFrame, clusters: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """The k active clusters with most notifying followers, with their articles (both more than 0)."""
    n = follows.where("notify").groupBy("cluster_id").agg(F.count_distinct("user_id").alias("followers"))
    m = members.groupBy("cluster_id").agg(F.count_distinct("article_id").alias("articles"))
    return n.join(clusters.where("is_active").select("cluster_id"), "cluster_id").join(m, "cluster_id").orderBy(F.desc("followers"), "cluster_id").limit(k)
