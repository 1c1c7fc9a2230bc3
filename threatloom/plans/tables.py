"""The article model over the driver's tables.

Each view is one SELECT that Spark and a reference SQL engine read alike; NAMES lists them in order of dependence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-08 00:00:00"

#: Dictionary rows: id, name, category, weight, source, synonyms (|-separated).
DICTIONARY = [
    (1, "thanedble", "apt_group", 95, "manual", "attion|retion"),
    (2, "erble", "malware_family", 85, "manual", ""),
    (3, "onou", "ransomware_group", 90, "misp", "onea|onha"),
    (4, "eriner", "company", 55, "manual", "antion"),
    (5, "anea", "platform", 50, "manual", ""),
    (6, "thble", "vulnerability", 80, "misp", "thsh|thnd"),
    (7, "ering", "campaign", 72, "manual", ""),
    (8, "of the", "security_vendor", 60, "manual", "in the|and the"),
    (9, "erth", "mitre_attack", 76, "misp", ""),
    (10, "elle", "country", 45, "manual", "ment"),
    (11, "onre", "apt_group", 91, "misp", ""),
    (12, "reti", "malware_family", 66, "dynamic", ""),
    (13, "und der", "company", 52, "misp", "der die"),
    (14, "que la", "tool", 58, "manual", ""),
]
#: Keyword rules: rule number, category, keyword, weight.
KEYWORDS = [
    (1, "critical", "tion", 90),
    (2, "critical", "an-the", 95),
    (3, "high", "erth_on", 70),
    (4, "high", "ment", 65),
    (5, "medium", "ung", 40),
    (6, "medium", "elle", 35),
    (7, "low", "rere", 20),
    (8, "low", "onan", 15),
    (9, "low", "que", 10),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


VIEWS: dict[str, str] = {
    "articles": """
        SELECT doc_id AS article_id, source AS feed, CAST(substr(source, 4) AS BIGINT) AS feed_id, trim(split_part(text, '.', 1)) AS title,
               text AS content, timestamp '2024-01-01 00:00:00' + interval '1' minute * doc_id AS published_at
        FROM documents""",
    "feeds": """
        SELECT feed_id, 'https://' || feed || '.example.net/rss' AS url, feed AS name,
               CASE WHEN feed_id % 2 = 0 THEN 'cybersecurity' ELSE 'general_news' END AS category,
               CAST(50 + (feed_id * 7) % 51 AS INT) AS credibility, feed_id % 10 <> 9 AS is_active
        FROM (SELECT DISTINCT feed, feed_id FROM articles) AS f""",
    "dictionary": f"""
        SELECT CAST(entity_id AS BIGINT) AS entity_id, name, category, CAST(weight AS INT) AS weight, source, synonyms
        FROM (VALUES {_values(DICTIONARY)}) AS t(entity_id, name, category, weight, source, synonyms)""",
    "keywords": f"""
        SELECT CAST(rule_no AS INT) AS rule_no, category, keyword, CAST(weight AS INT) AS weight
        FROM (VALUES {_values(KEYWORDS)}) AS t(rule_no, category, keyword, weight)""",
    "members": """
        SELECT cluster_id, article_id, article_id = min(article_id) OVER (PARTITION BY cluster_id) AS is_primary,
               CAST(1.0 - (article_id % 10) / 100.0 AS DOUBLE) AS similarity, published_at + interval '30' minute AS added_at
        FROM (SELECT article_id, published_at, CAST(CASE WHEN coalesce(feed_id, 20) = 0 THEN floor(article_id / 600) * 1000 ELSE floor(article_id / 60) * 100 + coalesce(feed_id, 20) END AS BIGINT) AS cluster_id FROM articles
              ) AS m""",
    "clusters": """
        SELECT cluster_id, 'story ' || CAST(cluster_id AS VARCHAR(20)) AS name, CAST(0.6 + (cluster_id % 40) / 100.0 AS DOUBLE) AS coherence,
               cluster_id % 10 <> 0 AS is_active, created_at, last_modified,
               CAST(CASE WHEN cluster_id % 7 = 0 THEN n - 1 ELSE n END AS INT) AS article_count,
               cluster_id % 3 = 0 AS has_summary,
               CASE WHEN cluster_id % 3 = 0 AND cluster_id % 2 = 0 THEN created_at + interval '1' hour END AS summary_at,
               CASE WHEN cluster_id % 4 <> 0 THEN 'named' END AS entities
        FROM (SELECT cluster_id, min(added_at) AS created_at, max(added_at) AS last_modified, count(*) AS n FROM members GROUP BY cluster_id) AS c""",
    "rankings": """
        SELECT article_id, cluster_id, recency_score, source_credibility, entity_importance, keyword_severity,
               CAST(floor(0.3 * recency_score + 0.2 * source_credibility + 0.2 * entity_importance + 0.3 * keyword_severity) AS INT) AS score
        FROM (SELECT m.article_id, m.cluster_id, CAST((m.article_id * 37) % 101 AS DOUBLE) AS recency_score,
                     CAST(f.credibility AS DOUBLE) AS source_credibility, CAST((m.article_id * 13) % 101 AS DOUBLE) AS entity_importance,
                     CAST((m.article_id * 53) % 101 AS DOUBLE) AS keyword_severity
              FROM members m JOIN articles a ON m.article_id = a.article_id JOIN feeds f ON a.feed_id = f.feed_id) AS r""",
    "ioc_lines": """
        SELECT event_type AS feed, event_id + 10 AS line_no,
               CASE event_id % 8 WHEN 5 THEN '# note' WHEN 6 THEN '' ELSE
                 CAST((user_id * 3) % 256 AS VARCHAR(9)) || '.' || CAST((user_id * 7) % 256 AS VARCHAR(9)) || '.' || CAST(event_id % 5 AS VARCHAR(9)) || '.' || CAST(user_id % 256 AS VARCHAR(9))
                 || chr(9) || CASE event_id % 4 WHEN 0 THEN 'Intel::ADDR' WHEN 1 THEN 'Intel::DOMAIN' WHEN 2 THEN '' ELSE 'Intel::ADDR' END || chr(9) || 'x' END AS line
        FROM events
        UNION ALL SELECT DISTINCT event_type, CAST(5 AS BIGINT), '#fields' || chr(9) || 'indicator' || chr(9) || 'indicator_type' FROM events
        UNION ALL SELECT DISTINCT event_type, CAST(1 AS BIGINT), '9.9.9.9' || chr(9) || 'Intel::ADDR' FROM events""",
    "plain_lines": """
        SELECT event_type AS feed, event_id AS line_no,
               CASE event_id % 5 WHEN 0 THEN '# c' WHEN 1 THEN '"HTTP://Bad' || CAST(user_id AS VARCHAR(9)) || '.Site' || CAST(event_id % 9 AS VARCHAR(9)) || '.ru:80/x",2024'
                 WHEN 2 THEN 'host' || CAST(user_id AS VARCHAR(9)) || '.local note' WHEN 3 THEN 'c2.net' || CAST(user_id % 40 AS VARCHAR(9)) || '.info' ELSE '// c' END AS line
        FROM events""",
    "galaxy": """
        SELECT CAST(article_id AS BIGINT) AS entity_id,
               CASE article_id % 3 WHEN 0 THEN 'T' || CAST(1000 + article_id % 9000 AS VARCHAR(9)) || ' - ' || title
                 WHEN 1 THEN title ELSE 'T' || CAST(1000 + article_id % 9000 AS VARCHAR(9)) || '.001' END AS value,
               CASE article_id % 5 WHEN 1 THEN 'T' || CAST(1000 + article_id % 9000 AS VARCHAR(9)) || ' ' || title ELSE title END AS name,
               CASE WHEN article_id % 2 = 0 THEN 'known ' || feed ELSE '' END AS description, CASE WHEN article_id % 4 = 0 THEN 'windows' END AS platforms,
               CASE WHEN article_id % 6 = 0 THEN 'impact' END AS phases, CASE WHEN article_id % 10 = 0 THEN 'logs' END AS data_sources, CASE WHEN article_id % 14 = 0 THEN 'look for ' || feed WHEN article_id % 7 = 0 THEN '' END AS detection,
               CASE WHEN article_id % 3 = 0 THEN 'misp' ELSE 'ai_extracted' END AS source, CASE article_id % 8 WHEN 1 THEN 'cve' WHEN 2 THEN 'domain' WHEN 5 THEN 'apt_group' ELSE 'company' END AS category
        FROM articles""",
    "bundle": """
        SELECT 'T' || CAST(1000 + (article_id * 2) % 9000 AS VARCHAR(9)) AS technique_id, CASE WHEN article_id % 4 = 0 THEN title ELSE 'b ' || title END AS name, 'bundle ' || feed AS description,
               'linux,' || feed AS platforms, CASE WHEN article_id % 3 > 0 THEN 'execution,' || feed END AS phases, 'process ' || feed AS data_sources, CASE WHEN article_id % 5 > 0 THEN 'watch ' || title END AS detection,
               article_id % 7 = 0 AS revoked, article_id
        FROM articles""",
    "users": """
        SELECT user_id, 'u' || CAST(user_id AS VARCHAR(20)) || '@mail.example' AS email, user_id % 7 <> 0 AS is_active, user_id % 3 <> 0 AS daily_email
        FROM (SELECT DISTINCT user_id FROM events) AS u""",
    "cluster_follows": """
        SELECT user_id, cluster_id, user_id % 5 <> 0 AS notify, timestamp '2024-01-01 00:00:00' + interval '1' minute * (user_id * 3) AS created_at,
               CASE WHEN user_id % 2 = 0 THEN timestamp '2024-01-01 00:00:00' + interval '1' minute * (user_id * 5) END AS last_notified_at
        FROM (SELECT DISTINCT e.user_id, m.cluster_id FROM events e JOIN members m ON e.event_id = m.article_id) AS f""",
    "entity_follows": """
        SELECT user_id, user_id * 10 + entity_id % 2 AS feed_id, entity_id, user_id % 4 <> 0 AS notify,
               CASE WHEN user_id % 2 = 0 THEN timestamp '2024-01-01 00:00:00' + interval '1' minute * (user_id * 4) END AS last_activity
        FROM (SELECT DISTINCT user_id, 1 + event_id % 14 AS entity_id FROM events) AS f""",
}
NAMES = list(VIEWS)
TABLES = ("documents", "events", "pages", "embeddings")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over sf_dir, each built from the views that it reads."""
    import re

    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in VIEWS:
                sql, used = VIEWS[name], {}
                for other in [*NAMES, *TABLES]:
                    new = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {{{other}}}", sql)
                    if new != sql:
                        sql, used[other] = new, get(other)
                made[name] = spark.sql(sql, **used) if used else spark.sql(sql)
            else:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return made[name]

    return [get(n) for n in names]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of one lone file over all cores, for work on texts that costs more than moving them: a row group is one task.
    Tables of several files stay where they are."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if len(rows.inputFiles()) == 1 else rows


def with_views(sql: str, *names: str) -> str:
    """sql behind the named views and those that they read, as common table expressions."""
    import re

    need: set[str] = set()

    def add(name: str) -> None:
        if name in VIEWS and name not in need:
            need.add(name)
            for other in re.findall(r"\b(?:FROM|JOIN) (\w+)\b", VIEWS[name]):
                add(other)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in NAMES if n in need]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
