"""Threat reports, summaries and maintenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .ranking import cluster_rankings, half_up

#: A table of hits, or a function that makes the hits of given article ids (article_id).
Hits = DataFrame | Callable[[DataFrame], DataFrame]


def since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key by an order that ends in a unique column."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def hits_of(hits: Hits, ids: DataFrame) -> DataFrame:
    """The hits of the articles of ids (article_id, distinct)."""
    return hits(ids) if callable(hits) else hits.join(ids, "article_id", "left_semi")


def cluster_entities(members: DataFrame, hits: Hits, min_weight: int, k: int) -> DataFrame:
    """cluster_id, names: the k heaviest entities of a cluster's articles, by weight and name."""
    own = members.select("cluster_id", "article_id")
    named = hits_of(hits, own.select("article_id").distinct()).where(F.col("weight") >= min_weight).select("article_id", "name", "weight")
    best = top_k(own.join(named, "article_id").groupBy("cluster_id", "name").agg(F.max("weight").alias("weight")), ["cluster_id"], [F.desc("weight"), "name"], k)
    return best.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), "|").alias("entities"))


def with_entities(best: DataFrame, members: DataFrame, hits: Hits, min_weight: int, k: int) -> DataFrame:
    """A short list of clusters with their entities; only the articles of its clusters are looked at."""
    best = materialize(best, "best")
    own = members.join(F.broadcast(best.select("cluster_id")), "cluster_id", "left_semi")  # a top list
    return best.join(cluster_entities(own, hits, min_weight, k), "cluster_id", "left")


def top_threat_clusters(clusters: DataFrame, members: DataFrame, rankings: DataFrame, articles: DataFrame, hits: Hits, as_of: str, hours: int, k: int) -> DataFrame:
    """H1: the k best clusters created within the window: articles, mean and cluster score, primary title, entities."""
    recent = clusters.where("is_active").where(F.col("created_at") >= since(as_of, hours))
    scored = members.join(rankings, ["article_id", "cluster_id"]).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("articles"), F.avg("score").alias("mean"))
    titles = members.where("is_primary").join(articles.select("article_id", "title"), "article_id").groupBy("cluster_id").agg(F.min("title").alias("title"))
    rows = recent.select("cluster_id", "name", "coherence").join(scored, "cluster_id").join(titles, "cluster_id", "left")
    best = rows.select("cluster_id", "name", "articles", F.round("mean", 6).alias("mean"), half_up(F.col("mean") * 0.7 + F.col("coherence") * 30).cast("int").alias("score"), "title").orderBy(F.desc("score"), "cluster_id").limit(k)
    return with_entities(best, members, hits, 70, 10)


def top_unclustered(articles: DataFrame, rankings: DataFrame, members: DataFrame, hits: Hits, feeds: DataFrame, as_of: str, hours: int, k: int, internal: str, least: int = 60) -> DataFrame:
    """H2: the k best articles of the window outside any cluster and outside the internal feed, with their source, the score's
    factors, a 500-character preview and up to 5 entities of weight 50."""
    recent = articles.where(F.col("published_at") >= since(as_of, hours)).select("article_id", "feed_id", "title", F.left("content", F.lit(500)).alias("preview"))
    recent = recent.join(feeds.where(F.col("name") != internal).select("feed_id", F.col("name").alias("source")), "feed_id").drop("feed_id")
    factors = ["recency_score", "source_credibility", "entity_importance", "keyword_severity"]
    rows = rankings.where(F.col("score") >= least).select("article_id", "score", *factors).join(members.select("article_id").distinct(), "article_id", "left_anti")
    best = rows.join(recent, "article_id").orderBy(F.desc("score"), "article_id").limit(k).withColumn("cluster_id", F.col("article_id"))
    best = materialize(best, "best")
    return best.join(cluster_entities(best, hits, 50, 5), "cluster_id", "left").drop("cluster_id")


def severity_index(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """H3: the mean of the 5 best cluster and 3 best article scores, times 1.2, cut, 100 at most; 50 without any."""
    best = clusters.select("score").orderBy(F.desc("score")).limit(5).unionByName(articles.select("score").orderBy(F.desc("score")).limit(3))
    return best.agg(F.coalesce(F.least(F.lit(100), F.floor(F.avg("score") * 1.2)), F.lit(50)).cast("int").alias("severity"))


def brief_entities(clusters: DataFrame, articles: DataFrame, dictionary: DataFrame, k: int = 20) -> DataFrame:
    """H4: entities of the listed clusters (2 each) and articles (1 each), resolved to ids, by count and name."""
    part = lambda df, n: df.select(F.explode(F.split("entities", r"\|")).alias("name"), F.lit(n).alias("n"))
    rows = part(clusters, 2).unionByName(part(articles, 1)).groupBy("name").agg(F.sum("n").alias("n"))
    return rows.join(dictionary.groupBy("name").agg(F.min("entity_id").alias("entity_id")), "name").orderBy(F.desc("n"), "name").limit(k)


def digest_lines(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """H5: ranked lines of the 10 best clusters and 5 best articles; both inputs are top lists already."""
    line = lambda df, kind, key, k: top_k(df.withColumn("kind", F.lit(kind)), ["kind"], [F.desc("score"), key], k).select("kind", "rn", F.format_string("%d. %s (score %d)", "rn", F.coalesce("title", F.lit("")), "score").alias("line"))
    return line(clusters, "cluster", "cluster_id", 10).unionByName(line(articles, "article", "article_id", 5))


def publish_digest(lines: DataFrame, articles: DataFrame, title: str, score: int) -> DataFrame:
    """H6: the digest as one article row, or none if its title is there already."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "rn", "line"))), lambda x: x["line"]), "\n")
    one = lines.agg(body.alias("content")).select(F.lit(title).alias("title"), "content", F.lit(score).alias("score"))
    return one.join(articles.select("title"), "title", "left_anti")


def bulletin_clusters(clusters: DataFrame, members: DataFrame, articles: DataFrame, rankings: DataFrame, hits: Hits, as_of: str, k: int, threat: str, announce: str) -> DataFrame:
    """H7: clusters with an article of the last 24 h, two articles or more, mean score 40 or more, a threat entity or threat
    word, and no announcement title. Entities are looked for only where all else holds and no title has a threat word."""
    a = articles.select("article_id", "published_at", F.lower("title").alias("t"))
    rows = members.select("cluster_id", "article_id").join(a, "article_id").join(rankings.select("article_id", "score"), "article_id")
    g = rows.groupBy("cluster_id").agg(
        F.max("published_at").alias("latest"), F.count(F.lit(1)).alias("articles"), F.avg("score").alias("mean"),
        F.coalesce(F.bool_or(F.col("t").rlike(threat)), F.lit(False)).alias("word"), F.coalesce(F.bool_or(F.col("t").rlike(announce)), F.lit(False)).alias("announcement"),
    )
    good = g.where((F.col("latest") >= since(as_of, 24)) & (F.col("articles") >= 2) & (F.col("mean") >= 40) & ~F.col("announcement"))
    good = materialize(good.join(clusters.where("is_active").select("cluster_id", "name"), "cluster_id").select("cluster_id", "name", "articles", "mean", "word"), "bulletin")
    asked = members.select("cluster_id", "article_id").join(good.where("NOT word").select("cluster_id"), "cluster_id", "left_semi")
    asked = asked.join(rankings.select("article_id"), "article_id", "left_semi")
    threats = hits_of(hits, asked.select("article_id").distinct()).where(F.col("category").isin("apt_group", "malware_family", "ransomware_group", "vulnerability")).select("article_id").distinct()
    named = asked.join(threats, "article_id", "left_semi").select("cluster_id").distinct().withColumn("__named", F.lit(True))
    best = good.join(named, "cluster_id", "left").where(F.col("word") | F.coalesce("__named", F.lit(False)))
    best = best.select("cluster_id", "name", "articles", F.round("mean", 6).alias("mean")).orderBy(F.desc("mean"), "cluster_id").limit(k)
    return with_entities(best, members, hits, 0, 5)


def bulletin_members(members: DataFrame, clusters: DataFrame, k: int = 5) -> DataFrame:
    """H8: up to k articles of each listed cluster, the primary first, then by similarity."""
    rows = members.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return top_k(rows, ["cluster_id"], [F.desc("is_primary"), F.desc("similarity"), "article_id"], k).select("cluster_id", "article_id", "rn")


def trending(hits: Hits, articles: DataFrame, members: DataFrame, clusters: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """name, category, weight with distinct articles and active clusters of the window."""
    recent = articles.where(F.col("published_at") >= since(as_of, hours)).select("article_id")
    active = members.join(clusters.where("is_active").select("cluster_id"), "cluster_id").select("article_id", "cluster_id")
    rows = hits_of(hits, recent).join(active, "article_id", "left")
    return rows.groupBy("name", "category", "weight").agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("cluster_id").alias("clusters"))


def trending_cves(hits: DataFrame, articles: DataFrame, members: DataFrame, clusters: DataFrame, as_of: str, category: str = "cve", k: int = 10, hours: int = 24) -> DataFrame:
    """H9: the k most reported names of a category."""
    rows = trending(hits.where(F.col("category") == category), articles, members, clusters, as_of, hours)
    return rows.select("name", "articles", "clusters").orderBy(F.desc("articles"), "name").limit(k)


#: Categories of trending entities by priority.
PRIORITY = ["apt_group", "ransomware_group", "malware_family", "mitre_attack", "campaign", "vulnerability"]


def trending_entities(hits: Hits, articles: DataFrame, members: DataFrame, clusters: DataFrame, as_of: str, k: int = 10, hours: int = 24) -> DataFrame:
    """Of six categories, weight 60 or more, two articles or more: by category priority, articles and name."""
    heavy = lambda ids: hits_of(hits, ids).where(F.col("category").isin(PRIORITY) & (F.col("weight") >= 60))
    rows = trending(heavy, articles, members, clusters, as_of, hours).where("articles >= 2")
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("category"))
    return rows.withColumn("priority", place.cast("int")).orderBy("priority", F.desc("articles"), "name").limit(k)


def refresh_needed(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Active clusters whose summary is missing or stale, with the reason."""
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("current"))
    rows = clusters.where("is_active").join(n, "cluster_id", "left")
    reason = (
        F.when(~F.coalesce("has_summary", F.lit(False)), "never generated")
        .when(F.col("summary_at").isNull(), "no timestamp")
        .when(F.col("last_modified") > F.col("summary_at"), "content updated")
        .when(F.coalesce("current", F.lit(0)) != F.col("article_count"), "count mismatch")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("cluster_id", "reason", "created_at")


def refresh_queue(needed: DataFrame, k: int) -> DataFrame:
    """The first k by reason, the oldest first."""
    order = F.array_position(F.array(*map(F.lit, ["never generated", "no timestamp", "content updated", "count mismatch"])), F.col("reason"))
    return needed.orderBy(order, "created_at", "cluster_id").limit(k)


def without_summary(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Active clusters without a summary, with their number of articles, the oldest first."""
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("articles"))
    rows = clusters.where("is_active AND NOT has_summary").join(n, "cluster_id", "left")
    return rows.select("cluster_id", F.coalesce("articles", F.lit(0)).alias("articles"), "created_at").orderBy("created_at", "cluster_id")


def track_membership(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """article_count and last_modified of each cluster from its members."""
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("added_at").alias("m"))
    return clusters.join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("article_count"), F.greatest("last_modified", "m").alias("last_modified"))


def reading_list(members: DataFrame, articles: DataFrame, feeds: DataFrame, k: int = 20) -> DataFrame:
    """Up to k articles of each cluster: the primary, then by credibility and similarity."""
    rows = members.join(articles.select("article_id", "feed_id", "title", "content"), "article_id").join(feeds.select("feed_id", "credibility"), "feed_id")
    return top_k(rows, ["cluster_id"], [F.desc("is_primary"), F.desc("credibility"), F.desc("similarity"), "article_id"], k)


def reading_text(rows: DataFrame, cut: int = 1500) -> DataFrame:
    """Numbered blocks of a reading list: title, content cut, up to two quotes of 31 to 199 characters."""
    quotes = F.slice(F.filter(F.regexp_extract_all("content", F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.length(q).between(31, 199)), 1, 2)
    block = F.concat(F.col("rn").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n"), F.left(F.coalesce("content", F.lit("")), F.lit(cut)), F.when(F.size(quotes) > 0, F.concat(F.lit("\nquotes: "), F.array_join(quotes, " / "))).otherwise(""))
    return rows.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


#: Names of summary categories -> dictionary categories.
RENAMES = {
    "domains": "domain", "ip_addresses": "ip_address", "file_hashes": "file_hash", "cves": "cve", "apt_groups": "apt_group", "ransomware_groups": "ransomware_group",
    "malware_families": "malware_family", "attack_types": "attack_type", "mitre_attack": "mitre", "security_standards": "security_standard", "vulnerability_types": "vulnerability_type",
    "companies": "company", "industry_sectors": "industry_sector", "security_vendors": "security_vendor", "government_agencies": "government_agency", "countries": "country", "platforms": "platform",
}


def summary_entities(clusters: DataFrame, column: str = "entities") -> DataFrame:
    """cluster_id, category, name of nested JSON groups (group -> category -> names), renamed, trimmed, cut at 500."""
    nested = F.from_json(column, "map<string,map<string,array<string>>>")
    rows = clusters.select("cluster_id", F.explode(nested).alias("g", "m")).select("cluster_id", F.explode("m").alias("category", "names")).select("cluster_id", "category", F.explode("names").alias("name"))
    renamed = F.coalesce(F.create_map(*(F.lit(x) for kv in RENAMES.items() for x in kv))[F.col("category")], F.col("category"))
    return rows.select("cluster_id", renamed.alias("category"), F.left(F.trim("name"), F.lit(500)).alias("name")).where("name <> ''").distinct()


#: Weights of entities taken from summaries, by category; 50 of others.
AI_WEIGHTS = {
    "cve": 80, "apt_group": 85, "ransomware_group": 85, "malware_family": 80, "attack_type": 70, "mitre": 75, "security_standard": 60, "vulnerability_type": 70, "domain": 65, "ip_address": 65,
    "file_hash": 60, "company": 50, "security_vendor": 55, "government_agency": 60, "industry_sector": 50, "country": 45, "platform": 55,
}
AI_SOURCE = "ai_extracted"


def sync_entities(flat: DataFrame, dictionary: DataFrame, source: str = AI_SOURCE) -> DataFrame:
    """Names that the dictionary lacks, whatever their case, within the category; one spelling each, with the category's weight."""
    known = dictionary.select(F.lower("name").alias("__l"), "category").distinct()
    fresh = flat.groupBy(F.lower("name").alias("__l"), "category").agg(F.min("name").alias("name"))
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in AI_WEIGHTS.items() for x in kv))[F.col("category")], F.lit(50))
    return fresh.join(known, ["__l", "category"], "left_anti").select("name", "category", weight.alias("weight"), F.lit(source).alias("source"))


def link_entities(members: DataFrame, flat: DataFrame, dictionary: DataFrame, hits: DataFrame) -> DataFrame:
    """article_id, name, category of summary entities to add to the cluster's articles: resolved by exact name, not there
    yet; and n_new, how many the article gets."""
    known = flat.join(dictionary.select("name", "category").distinct(), ["name", "category"], "left_semi")
    rows = known.join(members.select("cluster_id", "article_id"), "cluster_id").select("article_id", "name", "category").distinct()
    fresh = rows.join(hits.select("article_id", "name", "category"), ["article_id", "name", "category"], "left_anti")
    return fresh.withColumn("n_new", F.count(F.lit(1)).over(Window.partitionBy("article_id")))  # an article's own entities


def recent_summaries(clusters: DataFrame, as_of: str, hours: int, entities: str = "entities") -> DataFrame:
    """Clusters summarised within the window whose summary has entities, the latest first."""
    return clusters.where(F.col("has_summary") & F.col(entities).isNotNull() & (F.col("summary_at") >= since(as_of, hours))).orderBy(F.desc("summary_at"), "cluster_id")


def needs_description(dictionary: DataFrame, k: int = 50, source: str = AI_SOURCE) -> DataFrame:
    """The newest k entries that summaries gave, other than plain identifiers, without a description."""
    named = dictionary.where((F.col("source") == source) & ~F.col("category").isin("cve", "domain", "ip_address", "file_hash"))
    return named.where(F.trim(F.coalesce("description", F.lit(""))) == "").orderBy(F.desc("entity_id")).limit(k)


def backfill_descriptions(dictionary: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions set only where there is none."""
    rows = dictionary.join(descriptions.withColumnRenamed("description", "__d"), "entity_id", "left")
    return rows.withColumn("description", F.coalesce(F.nullif(F.trim("description"), F.lit("")), "__d")).drop("__d")


def effectiveness(rows: DataFrame, key: list[str], k: int = 20) -> DataFrame:
    """Occurrences and mean score by key, the k most frequent."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean")).orderBy(F.desc("n"), *key).limit(k)


def top_clusters_with_articles(clusters: DataFrame, members: DataFrame, rankings: DataFrame, k: int = 5, each: int = 3) -> DataFrame:
    """The k clusters of the best mean score with their ``each`` best articles."""
    rows = members.select("cluster_id", "article_id").join(rankings.select("article_id", "score"), "article_id")
    best = rows.groupBy("cluster_id").agg(F.avg("score").alias("mean")).join(clusters.where("is_active").select("cluster_id"), "cluster_id", "left_semi").orderBy(F.desc("mean"), "cluster_id").limit(k)
    return top_k(rows.join(best.select("cluster_id"), "cluster_id"), ["cluster_id"], [F.desc("score"), "article_id"], each).select("cluster_id", "article_id", "score", "rn")


def clustering_overview(members: DataFrame, articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters, articles, sources and mean coherence over memberships."""
    rows = members.join(articles.select("article_id", "feed"), "article_id").join(clusters.where("is_active").select("cluster_id", "coherence"), "cluster_id")
    return rows.agg(F.count_distinct("cluster_id").alias("clusters"), F.count_distinct("article_id").alias("articles"), F.count_distinct("feed").alias("sources"), F.round(F.avg("coherence"), 6).alias("coherence"))


def top_ranked(articles: DataFrame, rankings: DataFrame, feeds: DataFrame, k: int = 15) -> DataFrame:
    """The k best articles with their source, its credibility and the time."""
    best = rankings.orderBy(F.desc("score"), "article_id").limit(k).select("article_id", "score")
    rows = best.join(articles.select("article_id", "title", "published_at", "feed_id"), "article_id").join(feeds.select("feed_id", F.col("name").alias("source"), "credibility"), "feed_id")
    return rows.drop("feed_id").orderBy(F.desc("score"), "article_id")


def recent_high(articles: DataFrame, rankings: DataFrame, feeds: DataFrame, k: int = 10, recency: int = 50, least: int = 60) -> DataFrame:
    """The k best articles of a recency above 50 and a score of 60 or more."""
    return top_ranked(articles, rankings.where((F.col("recency_score") > recency) & (F.col("score") >= least)), feeds, k)


def frequent_entities(members: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent entities of each cluster."""
    rows = members.select("cluster_id", "article_id").join(hits.select("article_id", "name", "category"), "article_id").groupBy("cluster_id", "name", "category").agg(F.count(F.lit(1)).alias("n"))
    return top_k(rows, ["cluster_id"], [F.desc("n"), "name", "category"], k)


def entities_by_category(members: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """the k most frequent names of each category of each cluster."""
    rows = members.select("cluster_id", "article_id").join(hits.select("article_id", "name", "category"), "article_id").groupBy("cluster_id", "category", "name").agg(F.count(F.lit(1)).alias("n"))
    return top_k(rows, ["cluster_id", "category"], [F.desc("n"), "name"], k)


def cluster_detail(members: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """The articles of each cluster, the primary first, then by similarity, with title, source and time."""
    rows = members.join(articles.select("article_id", "title", "feed_id", "published_at"), "article_id").join(feeds.select("feed_id", F.col("name").alias("source")), "feed_id", "left")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("is_primary"), F.desc("similarity"), "article_id")
    return rows.select("cluster_id", "article_id", "title", "source", "published_at", "is_primary", "similarity", F.row_number().over(order).alias("rn"))


def offtopic_feeds(clusters: DataFrame, members: DataFrame, articles: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Feeds with articles in clusters whose name is like one of the patterns."""
    named = clusters.where(reduce(lambda a, b: a | b, (F.lower("name").like(p) for p in patterns))).select("cluster_id")
    rows = members.join(named, "cluster_id", "left_semi").join(articles.select("article_id", "feed"), "article_id")
    return rows.groupBy("feed").agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("cluster_id").alias("clusters"))


def feed_summary(feeds: DataFrame) -> DataFrame:
    """Active feeds by category: number and mean credibility."""
    return feeds.where("is_active").groupBy("category").agg(F.count(F.lit(1)).alias("feeds"), F.round(F.avg("credibility"), 6).alias("credibility"))


def pipeline_status(tables: dict[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """Rows of the last hour, the last day and in all, by stage; tables: stage -> (table, time column)."""
    one = lambda n, df, c: df.agg(F.count_if(F.col(c) >= since(as_of, 1)).alias("last_hour"), F.count_if(F.col(c) >= since(as_of, 24)).alias("last_day"), F.count(F.lit(1)).alias("total")).select(F.lit(n).alias("stage"), "last_hour", "last_day", "total")
    return reduce(DataFrame.unionByName, (one(n, df, c) for n, (df, c) in tables.items()))


def recent_results(articles: DataFrame, rankings: DataFrame, clusters: DataFrame, k: int = 10, least: int = 60, best: int = 5) -> DataFrame:
    """Kind, id, name, score, articles: the latest k articles of a score of 60 or more, and the best active clusters."""
    rows = rankings.where(F.col("score") >= least).select("article_id", "score").join(articles.select("article_id", "title", "published_at"), "article_id").orderBy(F.desc("published_at"), F.desc("article_id")).limit(k)
    rows = rows.select(F.lit("article").alias("kind"), F.col("article_id").alias("id"), F.col("title").alias("name"), "score", F.lit(None).cast("long").alias("articles"))
    top = cluster_rankings(clusters, rankings).orderBy(F.desc("cluster_score"), "cluster_id").limit(best)
    return rows.unionByName(top.select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("id"), "name", F.col("cluster_score").alias("score"), "articles"))


def purge(tables: dict[str, DataFrame], clusters: DataFrame, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables without the doomed article ids, clusters with those left empty inactive, counts by table)."""
    kept = {n: t.join(doomed, "article_id", "left_anti") for n, t in tables.items()}
    counts = reduce(DataFrame.unionByName, (t.join(doomed, "article_id", "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(n).alias("name"), "removed") for n, t in tables.items()))
    alive = kept["members"].select("cluster_id").distinct().withColumn("__alive", F.lit(True))
    left = clusters.join(alive, "cluster_id", "left").withColumn("is_active", F.col("is_active") & F.coalesce("__alive", F.lit(False))).drop("__alive")
    return kept, left, counts


def check_summaries(df: DataFrame, column: str = "summary") -> DataFrame:
    """``valid`` JSON records have a summary, a list of key_insights, a list of ttps and an object of sources; and their
    fields: the summary cut at 4,000 characters, up to 6 insights and up to 8 ttps."""
    v = F.try_parse_json(column)
    text = F.try_variant_get(v, "$.summary", "string")
    kind = lambda field: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    some = lambda field, n: F.slice(F.try_variant_get(v, f"$.{field}", "array<string>"), 1, n)
    shapes = (kind("summary") == "STRING") & (F.trim(text) != "") & kind("key_insights").startswith("ARRAY") & kind("ttps").startswith("ARRAY") & kind("sources").startswith("OBJECT")
    valid = F.coalesce(shapes, F.lit(False))
    return df.withColumns({"valid": valid, "summary_text": F.when(valid, F.left(text, F.lit(4000))), "n_insights": F.when(valid, F.size(some("key_insights", 6))), "n_ttps": F.when(valid, F.size(some("ttps", 8)))})


def clean_description(text: Column) -> Column:
    """Citations and links out, blanks squeezed, an unmatched ``)`` and double dots out, cut at 500."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\(Citation:[^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    # what lies between closing brackets, joined by those that have an opening one
    parts = F.split(t, r"\)")
    opened = lambda x: F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
    balanced = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.struct(parts[0].alias("s"), opened(parts[0]).alias("d")),
        lambda a, x: F.struct(F.concat(a["s"], F.when(a["d"] > 0, ")").otherwise(""), x).alias("s"), (F.greatest(a["d"] - 1, F.lit(0)) + opened(x)).alias("d")),
        lambda a: a["s"],
    )
    t = F.when(t.contains(")"), balanced).otherwise(t)
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\.{2,}", ".")), F.lit(500))


def source_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The latest arrival of each source."""
    return reduce(DataFrame.unionByName, (df.agg(F.max(c).alias("latest")).select(F.lit(n).alias("source"), "latest") for n, (df, c) in tables.items()))


def stix_id(kind: Column | str, key: Column) -> Column:
    """A stable object id: the kind and a digest in the shape of a UUID."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    h = F.sha2(F.concat(k, F.lit("|"), key), 256)
    return F.concat(k, F.lit("--"), F.substring(h, 1, 8), *(F.concat(F.lit("-"), F.substring(h, a, b)) for a, b in ((9, 4), (13, 4), (17, 4), (21, 12))))


#: Object kind -> (dictionary categories, most per cluster).
STIX_KINDS = {"vulnerability": (["vulnerability", "cve"], 10), "threat-actor": (["apt_group", "ransomware_group"], 5), "malware": (["malware_family"], 5), "attack-pattern": (["mitre_attack"], 1000), "indicator": (["ip_address", "domain", "file_hash"], 10)}


def stix_pattern(category: Column, name: Column) -> Column:
    """The pattern of an indicator: an address, a domain, or a hash named by its length."""
    kinds = {32: "MD5", 40: "SHA1", 64: "SHA256"}
    digest = F.lit("UNKNOWN")
    for n, kind in kinds.items():
        digest = F.when(F.length(name) == n, kind).otherwise(digest)
    what = F.when(category == "domain", "domain-name:value").when(category == "file_hash", F.concat(F.lit("file:hashes."), digest)).otherwise(F.when(name.contains(":"), "ipv6-addr:value").otherwise("ipv4-addr:value"))
    return F.concat(F.lit("["), what, F.lit(" = '"), name, F.lit("']"))


def export_stix(clusters: DataFrame, members: DataFrame, hits: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """cluster_id, obj_type, obj_id, body (JSON): a report per cluster, its objects by kind up to each kind's number (the
    most named first), and "uses" edges from actors to malware and techniques of the same cluster.

    A report's description is the cluster's summary and insights (summaries: cluster_id, summary, insights array), its
    object_refs the sorted ids of the cluster's objects and edges.
    """
    kind = F.lit(None).cast("string")
    most = F.lit(0)
    for k, (cats, n) in STIX_KINDS.items():
        kind, most = F.when(F.col("category").isin(cats), k).otherwise(kind), F.when(F.col("category").isin(cats), n).otherwise(most)
    named = members.select("cluster_id", "article_id").join(hits.select("article_id", "name", "category"), "article_id").withColumns({"obj_type": kind, "most": most}).where("obj_type IS NOT NULL")
    counted = named.groupBy("cluster_id", "obj_type", "most", "name").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("category"))
    objects = counted.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id", "obj_type").orderBy(F.desc("n"), "name"))).where("rn <= most")
    at = clusters.select("cluster_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    objects = objects.join(at, "cluster_id").select("cluster_id", "obj_type", "name", "category", "at", stix_id(F.col("obj_type"), F.col("name")).alias("obj_id"))
    technique = F.regexp_extract("name", r"T\d{4}(?:\.\d{3})?", 0)
    link = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(technique, F.lit("."), F.lit("/")), F.lit("/"))
    external = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), technique.alias("external_id"), link.alias("url")))
    body = (
        F.when(F.col("obj_type") == "indicator", F.to_json(F.struct(F.concat("category", F.lit(": "), "name").alias("name"), F.lit("Indicator extracted from cluster").alias("description"), stix_pattern(F.col("category"), F.col("name")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.col("at").alias("valid_from"))))
        .when((F.col("obj_type") == "attack-pattern") & (technique != ""), F.to_json(F.struct("name", external.alias("external_references"))))
        .otherwise(F.to_json(F.struct("name")))
    )
    actors = objects.where("obj_type = 'threat-actor'").select("cluster_id", F.col("obj_id").alias("source_ref"))
    used = objects.where("obj_type IN ('malware', 'attack-pattern')").select("cluster_id", F.col("obj_id").alias("target_ref"), F.when(F.col("obj_type") == "malware", "Threat actor uses malware").otherwise("Threat actor uses technique").alias("description"))
    edges = actors.join(used, "cluster_id").select(  # at most 5 actors a cluster
        "cluster_id", F.lit("relationship").alias("obj_type"), stix_id("relationship", F.concat(F.col("source_ref"), F.col("target_ref"))).alias("obj_id"), F.to_json(F.struct(F.lit("uses").alias("relationship_type"), "source_ref", "target_ref", "description")).alias("body")
    )
    parts = objects.select("cluster_id", "obj_type", "obj_id", body.alias("body")).unionByName(edges)
    refs = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_set("obj_id")).alias("object_refs"))  # a few thousand at most
    told = F.lit("")
    rows = clusters.select("cluster_id", "name").join(at, "cluster_id").join(refs, "cluster_id", "left")
    if summaries is not None:
        rows = rows.join(summaries.select("cluster_id", "summary", "insights"), "cluster_id", "left")
        listed = F.concat(F.lit("\n\nKey Insights:\n"), F.array_join(F.transform("insights", lambda x: F.concat(F.lit("• "), x, F.lit("\n"))), ""))
        told = F.concat(F.coalesce("summary", F.lit("")), F.when(F.col("insights").isNotNull(), listed).otherwise(""))
    report = F.struct("name", told.alias("description"), F.col("at").alias("published"), F.lit(80).alias("confidence"), F.lit("en").alias("lang"), F.coalesce("object_refs", F.array().cast("array<string>")).alias("object_refs"))
    reports = rows.select("cluster_id", F.lit("report").alias("obj_type"), stix_id("report", F.col("cluster_id").cast("string")).alias("obj_id"), F.to_json(report).alias("body"))
    return reports.unionByName(parts)
