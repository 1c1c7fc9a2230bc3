"""Queries of rankings, reports and follows with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import entities as E
from ..operators import follows as W
from ..operators import ranking as G
from ..operators import reports as H
from .q_entities import _DICT
from .tables import AS_OF, load, with_views

Q: dict = {}
SQL: dict[str, str] = {}
FMT = "'%Y-%m-%d %H:%M:%S'"


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


HITS = f"WITH {_DICT.strip()}"


def _hits(s, d):
    return E.match_dictionary(*load(s, d, "articles", "dictionary"))


def _some_hits(s, d):
    """Hits of given articles alone."""
    a, dic = load(s, d, "articles", "dictionary")
    return lambda ids: E.match_dictionary(a.join(ids, "article_id", "left_semi"), dic)


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- rankings
@query("g1_to_rank", f"""SELECT a.article_id, min(cluster_id) AS cluster_id FROM articles a LEFT JOIN members m ON a.article_id = m.article_id
    WHERE published_at >= timestamp '{AS_OF}' - interval '160' hour GROUP BY 1""", "articles", "members")
def _(s, d):
    a, m, r = load(s, d, "articles", "members", "rankings")
    return G.to_rank(a, m, r, AS_OF, 160).select("article_id", "cluster_id")


@query("g1_to_rank_all", "SELECT a.article_id, min(cluster_id) AS cluster_id FROM articles a LEFT JOIN members m ON a.article_id = m.article_id WHERE a.article_id NOT IN (SELECT article_id FROM rankings WHERE score > 40) GROUP BY 1", "articles", "members", "rankings")
def _(s, d):
    a, m, r = load(s, d, "articles", "members", "rankings")
    return G.to_rank(a, m, r.where("score > 40"), AS_OF, 0, True).select("article_id", "cluster_id")


_REC = "coalesce(greatest(0.0, least(100.0, 100.0 * (1 - (epoch_us(timestamp '2024-01-01 18:00:00') - epoch_us(published_at)) / 3.6e9 / 24.0))), 0.0)"


@query("g2_recency_score", f"SELECT article_id, round({_REC}, 6) AS recency FROM articles", "articles")
def _(s, d):
    return load(s, d, "articles")[0].select("article_id", F.round(G.recency_score(F.col("published_at"), "2024-01-01 18:00:00"), 6).alias("recency"))


@query("g3_source_score", "SELECT article_id, CAST(CASE WHEN credibility IS NULL THEN 50 ELSE greatest(0, least(100, credibility)) END AS DOUBLE) AS source FROM articles LEFT JOIN feeds USING (feed_id)", "articles", "feeds")
def _(s, d):
    a, f = load(s, d, "articles", "feeds")
    return a.join(f.select("feed_id", "credibility"), "feed_id", "left").select("article_id", G.source_score(F.col("credibility")).alias("source"))


_ENT = """es AS (SELECT article_id, avg(weight) AS mean, count(*) FILTER (weight >= 80) AS strong, count(*) AS entity_count, string_agg(CASE WHEN weight >= 70 THEN name END, '|' ORDER BY name) AS contributing FROM hits GROUP BY 1),
e2 AS (SELECT article_id, round(CASE WHEN strong >= 3 THEN least(100.0, mean + least(20, 5 * strong)) ELSE mean END, 6) AS entity_importance, entity_count, contributing FROM es)"""


@query("g4_entity_score", f"{HITS}, {_ENT} SELECT article_id, entity_importance, entity_count, coalesce(contributing, '') AS contributing FROM e2", "articles", "dictionary")
def _(s, d):
    a, dic = load(s, d, "articles", "dictionary")
    rows = G.entity_score(E.match_dictionary(a, dic), dic)
    return rows.select("article_id", "entity_importance", "entity_count", F.array_join(F.transform("contributing", lambda x: x["name"]), "|").alias("contributing"))


_VAR = """kv AS (SELECT rule_no, weight, category, unnest([lower(keyword), replace(lower(keyword), '_', ' '), replace(lower(keyword), '-', ' ')]) AS variant FROM keywords),
va AS (SELECT variant, max(rule_no) AS rule_no, arg_max(category, rule_no) AS category, arg_max(weight, rule_no) AS weight FROM kv GROUP BY 1)"""
_KEY = """kh AS (SELECT article_id, rule_no, variant, CASE WHEN contains(lower(coalesce(title, '')), variant) THEN 2 * weight WHEN contains(lower(coalesce(content, '')), variant) THEN weight END AS points FROM articles, va),
k5 AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY points DESC, rule_no, variant) AS rn FROM kh WHERE points IS NOT NULL),
ks AS (SELECT a.article_id, coalesce(round(sum(points) / (200 * count(points)) * 100, 6), 0.0) AS keyword_severity, coalesce(string_agg(variant, '|' ORDER BY rn), '') AS matches FROM articles a LEFT JOIN k5 ON a.article_id = k5.article_id AND rn <= 5 GROUP BY 1)"""


@query("g5_keyword_variants", f"WITH {_VAR}, art AS (SELECT count(*) AS n_articles FROM articles), hv AS (SELECT variant, count(*) AS n FROM articles, va WHERE contains(lower(content), variant) GROUP BY 1) SELECT va.variant, rule_no, category, weight, coalesce(n, 0) AS articles FROM va LEFT JOIN hv ON va.variant = hv.variant", "articles", "keywords")
def _(s, d):
    """The variants with the number of articles that hold each (a fixed set of counters, summed in one pass)."""
    a, k = load(s, d, "articles", "keywords")
    variants = G.keyword_variants(k)
    names = sorted(r["variant"] for r in variants.collect())
    n = a.select(F.lower("content").alias("x")).agg(*(F.count_if(F.col("x").contains(v)).alias(f"c{i}") for i, v in enumerate(names)))
    counts = n.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"c{i}").alias("articles")) for i, v in enumerate(names)))).alias("r")).select("r.*")
    return variants.join(counts, "variant")


@query("g6_keyword_score", f"WITH {_VAR}, {_KEY} SELECT article_id, keyword_severity, matches FROM ks", "articles", "keywords")
def _(s, d):
    a, k = load(s, d, "articles", "keywords")
    return G.keyword_score(a, G.keyword_variants(k)).select("article_id", "keyword_severity", F.array_join("matches", "|").alias("matches"))


_SCORE = f"""sc AS (SELECT a.article_id, a.published_at, {_REC} AS recency_score, CAST(coalesce(credibility, 50) AS DOUBLE) AS source_credibility, coalesce(entity_importance, 0.0) AS entity_importance, keyword_severity
    FROM articles a LEFT JOIN feeds f ON a.feed_id = f.feed_id LEFT JOIN e2 ON e2.article_id = a.article_id JOIN ks ON ks.article_id = a.article_id),
s2 AS (SELECT *, recency_score * 0.3 + source_credibility * 0.2 + entity_importance * 0.2 + keyword_severity * 0.3 AS v FROM sc)"""


def _scored(s, d):
    a, f, dic, k = load(s, d, "articles", "feeds", "dictionary", "keywords")
    rows = a.join(f.select("feed_id", "credibility"), "feed_id", "left").withColumns({"recency_score": G.recency_score(F.col("published_at"), "2024-01-01 18:00:00"), "source_credibility": G.source_score(F.col("credibility"))})
    rows = rows.join(G.entity_score(E.match_dictionary(a, dic), dic).select("article_id", "entity_importance"), "article_id", "left").withColumn("entity_importance", F.coalesce("entity_importance", F.lit(0.0)))
    return G.article_score(rows.join(G.keyword_score(a, G.keyword_variants(k)), "article_id"))


@query("g7_article_score", f"{HITS}, {_ENT}, {_VAR}, {_KEY}, {_SCORE} SELECT article_id, floor(round(greatest(0, least(100, v)), 6) + 0.5)::INT AS score FROM s2", "articles", "feeds", "dictionary", "keywords")
def _(s, d):
    rows = _scored(s, d)
    exact = sum((F.col(c) * w for c, w in G.WEIGHTS.items()), F.lit(0.0))
    return rows.select("article_id", G.half_up(F.greatest(F.lit(0), F.least(F.lit(100), exact))).cast("int").alias("score"))


@query("flagship_ranked_articles", f"""{HITS}, {_ENT}, {_VAR}, {_KEY}, {_SCORE} SELECT s2.article_id, feed, title, floor(round(greatest(0, least(100, v)) * 10, 6) + 0.5) / 10 AS score, round(recency_score, 6) AS recency_score,
    source_credibility, entity_importance, s2.keyword_severity, matches FROM s2 JOIN articles a ON a.article_id = s2.article_id JOIN ks ON ks.article_id = s2.article_id ORDER BY score DESC, s2.article_id LIMIT 20""", "articles", "feeds", "dictionary", "keywords")
def flagship(s, d):
    """The 20 best articles with their factors and matched keywords (the pipeline's end product)."""
    rows = _scored(s, d).select("article_id", "feed", "title", "score", F.round("recency_score", 6).alias("recency_score"), "source_credibility", "entity_importance", "keyword_severity", F.array_join("matches", "|").alias("matches"))
    return rows.orderBy(F.desc("score"), "article_id").limit(20)


@query("g8_write_rankings", "SELECT article_id, coalesce(n.score, o.score) AS score FROM (SELECT article_id, score FROM rankings WHERE keyword_severity < 60) o FULL JOIN (SELECT article_id, CAST(floor(recency_score) AS INT) AS score FROM rankings WHERE source_credibility > 70) n USING (article_id)", "rankings")
def _(s, d):
    (r,) = load(s, d, "rankings")
    old = r.where("keyword_severity < 60").select("article_id", "cluster_id", "score")
    return G.write_rankings(old, r.where("source_credibility > 70").select("article_id", "cluster_id", F.col("recency_score").alias("score"))).select("article_id", "score")


_MEAN = "mn AS (SELECT m.cluster_id, avg(score) AS mean, count(*) AS n FROM members m JOIN rankings r ON m.article_id = r.article_id GROUP BY 1)"


@query("g9_cluster_score", f"WITH {_MEAN} SELECT cluster_id, n, floor(round(CASE WHEN n >= 5 THEN least(100.0, mean * 0.7 + coherence * 30 + least(10, n)) ELSE mean * 0.7 + coherence * 30 END * 10, 6) + 0.5) / 10 AS score FROM mn JOIN clusters USING (cluster_id)", "members", "rankings", "clusters")
def _(s, d):
    m, r, c = load(s, d, "members", "rankings", "clusters")
    return G.cluster_score(m, r, c)


@query("g10_cluster_rankings", "SELECT c.cluster_id, name, count(*) AS articles, floor(round(avg(score) * 100, 6) + 0.5) / 100 AS avg_score, CAST(floor(round(avg(score) * 0.7 + coherence * 30, 6) + 0.5) AS INT) AS cluster_score FROM clusters c JOIN rankings r ON c.cluster_id = r.cluster_id WHERE is_active GROUP BY c.cluster_id, name, coherence", "clusters", "rankings")
def _(s, d):
    c, r = load(s, d, "clusters", "rankings")
    return G.cluster_rankings(c, r)


@query("g11_articles_with_rankings", """SELECT a.article_id, title, f.name AS feed_name, credibility, score, recency_score, source_credibility, entity_importance, keyword_severity, c.name AS cluster_name
    FROM articles a JOIN feeds f ON a.feed_id = f.feed_id JOIN rankings r ON r.article_id = a.article_id LEFT JOIN clusters c ON c.cluster_id = r.cluster_id""", "articles", "feeds", "rankings", "clusters")
def _(s, d):
    a, f, r, c = load(s, d, "articles", "feeds", "rankings", "clusters")
    return G.articles_with_rankings(a, f, r, c)


@query("g12_score_distribution", "SELECT count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, round(stddev_samp(score), 6) AS deviation, count(*) FILTER (score >= 90) AS critical, count(*) FILTER (score BETWEEN 70 AND 89) AS high, count(*) FILTER (score BETWEEN 50 AND 69) AS medium, count(*) FILTER (score < 50) AS low FROM rankings", "rankings")
def _(s, d):
    return G.score_distribution(*load(s, d, "rankings"))


@query("g13_ranking_stats", "SELECT round(avg(score), 6) AS score, round(avg(recency_score), 6) AS recency_score, round(avg(source_credibility), 6) AS source_credibility, round(avg(entity_importance), 6) AS entity_importance, round(avg(keyword_severity), 6) AS keyword_severity, count(DISTINCT cluster_id) AS clusters FROM rankings", "rankings")
def _(s, d):
    return G.ranking_stats(*load(s, d, "rankings"))


# --- reports
_CE = "{n} AS (SELECT cluster_id, string_agg(name, '|' ORDER BY rn) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, name) AS rn FROM (SELECT cluster_id, name, max(weight) AS weight FROM {m} m JOIN hits h ON m.article_id = h.article_id WHERE weight >= {w} GROUP BY 1, 2)) WHERE rn <= {k} GROUP BY 1)"
_H1 = f"""t1 AS (SELECT m.cluster_id, count(*) AS articles, avg(score) AS mean FROM members m JOIN rankings r ON m.article_id = r.article_id AND m.cluster_id = r.cluster_id GROUP BY 1),
tt AS (SELECT cluster_id, min(title) AS title FROM members m JOIN articles a ON m.article_id = a.article_id WHERE is_primary GROUP BY 1), {_CE.format(n='ce', m='members', w=70, k=10)},
h1 AS (SELECT c.cluster_id, c.name, articles, round(mean, 6) AS mean, CAST(floor(round(mean * 0.7 + coherence * 30, 6) + 0.5) AS INT) AS score, title FROM clusters c JOIN t1 ON c.cluster_id = t1.cluster_id LEFT JOIN tt ON tt.cluster_id = c.cluster_id
       WHERE is_active AND created_at >= timestamp '{AS_OF}' - interval '164' hour ORDER BY score DESC, c.cluster_id LIMIT 10)"""
_H2 = f"""rm AS (SELECT article_id AS cluster_id, article_id FROM rankings), {_CE.format(n='ae', m='rm', w=50, k=5)},
h2 AS (SELECT r.article_id, score, recency_score, source_credibility, entity_importance, keyword_severity, title, left(content, 500) AS preview, f.name AS source FROM rankings r JOIN articles a ON a.article_id = r.article_id JOIN feeds f ON f.feed_id = a.feed_id
      WHERE published_at >= timestamp '{AS_OF}' - interval '166' hour AND f.name <> 'src3' AND score >= 60 AND r.article_id NOT IN (SELECT article_id FROM members WHERE cluster_id % 100 < 10) ORDER BY score DESC, r.article_id LIMIT 10)"""
_REP = ("articles", "dictionary", "members", "rankings", "clusters", "feeds")


def _h1(s, d):
    a, m, r, c = load(s, d, "articles", "members", "rankings", "clusters")
    return H.top_threat_clusters(c, m, r, a, _some_hits(s, d), AS_OF, 164, 10)


def _h2(s, d):
    a, m, r, f = load(s, d, "articles", "members", "rankings", "feeds")
    return H.top_unclustered(a, r, m.where("cluster_id % 100 < 10"), _some_hits(s, d), f, AS_OF, 166, 10, internal="src3")


@query("h1_top_threat_clusters", f"{HITS}, {_H1} SELECT h1.*, entities FROM h1 LEFT JOIN ce ON ce.cluster_id = h1.cluster_id", *_REP)
def _(s, d):
    return _h1(s, d)


@query("h2_top_unclustered", f"{HITS}, {_H2} SELECT h2.*, entities FROM h2 LEFT JOIN ae ON ae.cluster_id = h2.article_id", *_REP)
def _(s, d):
    return _h2(s, d)


@query("h3_severity_index", f"{HITS}, {_H1}, {_H2} SELECT CAST(coalesce(least(100, floor(avg(score) * 1.2)), 50) AS INT) AS severity FROM (SELECT * FROM (SELECT score FROM h1 ORDER BY score DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT score FROM h2 ORDER BY score DESC LIMIT 3))", *_REP)
def _(s, d):
    return H.severity_index(_h1(s, d), _h2(s, d))


@query("h4_brief_entities", f"""{HITS}, {_H1}, {_H2}, be AS (SELECT unnest(string_split(entities, '|')) AS name, 2 AS n FROM h1 JOIN ce ON ce.cluster_id = h1.cluster_id UNION ALL SELECT unnest(string_split(entities, '|')), 1 FROM h2 JOIN ae ON ae.cluster_id = h2.article_id)
    SELECT be.name, sum(n)::BIGINT AS n, min(entity_id) AS entity_id FROM be JOIN (SELECT name, min(entity_id) AS entity_id FROM dictionary GROUP BY 1) d ON d.name = be.name GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", *_REP)
def _(s, d):
    return H.brief_entities(_h1(s, d), _h2(s, d), load(s, d, "dictionary")[0])


_LINES = "ln AS (SELECT 'cluster' AS kind, rn, rn || '. ' || coalesce(title, '') || ' (score ' || score || ')' AS line FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cluster_id) AS rn FROM h1) WHERE rn <= 10 UNION ALL SELECT 'article', rn, rn || '. ' || coalesce(title, '') || ' (score ' || score || ')' FROM (SELECT *, row_number() OVER (ORDER BY score DESC, article_id) AS rn FROM h2) WHERE rn <= 5)"


@query("h5_digest_lines", f"{HITS}, {_H1}, {_H2}, {_LINES} SELECT kind, rn, line FROM ln", *_REP)
def _(s, d):
    return H.digest_lines(_h1(s, d), _h2(s, d))


@query("h6_publish_digest", f"{HITS}, {_H1}, {_H2}, {_LINES} SELECT 'Daily brief 2024-01-08' AS title, string_agg(line, chr(10) ORDER BY kind, rn) AS content, 80 AS score FROM ln", *_REP)
def _(s, d):
    return H.publish_digest(H.digest_lines(_h1(s, d), _h2(s, d)), load(s, d, "articles")[0], "Daily brief 2024-01-08", 80)


_CUT = "2024-01-01 20:00:00"
_H7 = f"""b7 AS (SELECT m.cluster_id, max(published_at) AS latest, count(*) AS articles, avg(score) AS mean, bool_or(regexp_matches(lower(title), 'tion|erth')) AS word, bool_or(regexp_matches(lower(title), 'ung|que la')) AS ann,
      count(*) FILTER (EXISTS (SELECT 1 FROM hits h WHERE h.article_id = m.article_id AND category IN ('apt_group', 'malware_family', 'ransomware_group', 'vulnerability'))) AS ents
      FROM members m JOIN articles a ON a.article_id = m.article_id JOIN rankings r ON r.article_id = m.article_id GROUP BY 1), {_CE.format(n='c0', m='members', w=0, k=5)},
h7 AS (SELECT b7.cluster_id, name, articles, round(mean, 6) AS mean FROM b7 JOIN clusters c ON c.cluster_id = b7.cluster_id WHERE is_active AND latest >= timestamp '{_CUT}' - interval '24' hour AND articles >= 2 AND mean >= 40 AND (coalesce(word, false) OR ents > 0) AND NOT coalesce(ann, false) ORDER BY round(mean, 6) DESC, b7.cluster_id LIMIT 15)"""


def _h7(s, d):
    a, m, r, c = load(s, d, "articles", "members", "rankings", "clusters")
    return H.bulletin_clusters(c, m, a, r, _some_hits(s, d), _CUT, 15, "tion|erth", "ung|que la")


@query("h7_bulletin_clusters", f"{HITS}, {_H7} SELECT h7.*, entities FROM h7 LEFT JOIN c0 ON c0.cluster_id = h7.cluster_id", *_REP)
def _(s, d):
    return _h7(s, d)


@query("h8_bulletin_members", "SELECT cluster_id, article_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY is_primary DESC, similarity DESC, article_id) AS rn FROM members WHERE cluster_id IN (SELECT cluster_id FROM clusters WHERE is_active)) WHERE rn <= 5", "members", "clusters")
def _(s, d):
    m, c = load(s, d, "members", "clusters")
    return H.bulletin_members(m, c.where("is_active"))


_TREND = f"""tr AS (SELECT h.name, h.category, h.weight, count(DISTINCT h.article_id) AS articles, count(DISTINCT c.cluster_id) AS clusters FROM hits h JOIN articles a ON a.article_id = h.article_id AND published_at >= timestamp '{_CUT}' - interval '24' hour
    LEFT JOIN (SELECT article_id, m.cluster_id FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id WHERE is_active) c ON c.article_id = h.article_id GROUP BY 1, 2, 3)"""
_PRIO = "list_position(['apt_group', 'ransomware_group', 'malware_family', 'mitre_attack', 'campaign', 'vulnerability'], category)"


@query("h9_trending_cves", f"""WITH cv AS (SELECT article_id, coalesce(content, '') || ' see cve-20' || (10 + article_id % 15) || '-' || (1000 + article_id % 37) AS x FROM articles),
    hits AS (SELECT article_id, name, 'cve' AS category, 80 AS weight FROM (SELECT article_id, unnest(regexp_extract_all(x, '(?i)CVE-\\d{{4}}-\\d{{4,}}')) AS name FROM cv)), {_TREND} SELECT name, articles, clusters FROM tr ORDER BY articles DESC, name LIMIT 10""", "articles", "members", "clusters")
def _(s, d):
    """The CVEs of C1 and C2 in the articles, each of which names one more, made of its id."""
    a, m, c = load(s, d, "articles", "members", "clusters")
    cve = F.concat(F.lit(" see cve-20"), (F.lit(10) + F.col("article_id") % 15).cast("string"), F.lit("-"), (F.lit(1000) + F.col("article_id") % 37).cast("string"))
    texts = a.select("article_id", F.lit("").alias("title"), F.concat(F.coalesce("content", F.lit("")), cve).alias("content"))
    hits = E.valid_entities(E.extract_patterns(texts, [p for p in R.PATTERNS if p[2] == "cve"])).withColumn("weight", F.lit(80))
    return H.trending_cves(hits, a, m, c, _CUT)


@query("h10_trending_entities", f"{HITS}, {_TREND} SELECT name, category, weight, articles, clusters, {_PRIO}::INT AS priority FROM tr WHERE {_PRIO} > 0 AND weight >= 60 AND articles >= 2 ORDER BY 6, articles DESC, name LIMIT 10", *_REP)
def _(s, d):
    a, m, c = load(s, d, "articles", "members", "clusters")
    return H.trending_entities(_some_hits(s, d), a, m, c, _CUT)


_NEED = """nc AS (SELECT cluster_id, count(*) AS current FROM members GROUP BY 1),
rf AS (SELECT c.cluster_id, created_at, CASE WHEN NOT coalesce(has_summary, false) THEN 'never generated' WHEN summary_at IS NULL THEN 'no timestamp' WHEN last_modified > summary_at THEN 'content updated' WHEN coalesce(current, 0) <> article_count THEN 'count mismatch' END AS reason
       FROM clusters c LEFT JOIN nc ON nc.cluster_id = c.cluster_id WHERE is_active)"""


@query("h11_refresh_needed", f"WITH {_NEED} SELECT cluster_id, reason FROM rf WHERE reason IS NOT NULL", "clusters", "members")
def _(s, d):
    return H.refresh_needed(*load(s, d, "clusters", "members")).select("cluster_id", "reason")


@query("h12_refresh_queue", f"WITH {_NEED} SELECT cluster_id, reason FROM rf WHERE reason IS NOT NULL ORDER BY list_position(['never generated', 'no timestamp', 'content updated', 'count mismatch'], reason), created_at, cluster_id LIMIT 20", "clusters", "members")
def _(s, d):
    return H.refresh_queue(H.refresh_needed(*load(s, d, "clusters", "members")), 20).select("cluster_id", "reason")


@query("h13_without_summary", f"SELECT c.cluster_id, count(article_id) AS articles, strftime(created_at, {FMT}) AS created_at, row_number() OVER (ORDER BY c.created_at, c.cluster_id) AS rn FROM clusters c LEFT JOIN members m ON m.cluster_id = c.cluster_id WHERE is_active AND NOT has_summary GROUP BY c.cluster_id, c.created_at ORDER BY c.created_at, c.cluster_id LIMIT 200", "clusters", "members")
def _(s, d):
    """The 200 oldest, numbered."""
    rows = H.without_summary(*load(s, d, "clusters", "members")).limit(200)
    place = F.row_number().over(Window.orderBy("created_at", "cluster_id"))  # of a top list
    return rows.select("cluster_id", "articles", _ts("created_at"), place.alias("rn"))


@query("h14_track_membership", f"SELECT c.cluster_id, count(article_id) AS article_count, strftime(greatest(max(last_modified), max(added_at)), {FMT}) AS last_modified FROM clusters c LEFT JOIN members m ON m.cluster_id = c.cluster_id GROUP BY 1", "clusters", "members")
def _(s, d):
    return H.track_membership(*load(s, d, "clusters", "members")).select("cluster_id", "article_count", _ts("last_modified"))


_RL = "rl AS (SELECT * FROM (SELECT m.cluster_id, m.article_id, a.title, a.content, row_number() OVER (PARTITION BY m.cluster_id ORDER BY is_primary DESC, credibility DESC, similarity DESC, m.article_id) AS rn FROM members m JOIN articles a ON a.article_id = m.article_id JOIN feeds f ON f.feed_id = a.feed_id) WHERE rn <= 20)"


@query("h15_reading_list", f"WITH {_RL} SELECT cluster_id, article_id, rn FROM rl", "members", "articles", "feeds")
def _(s, d):
    return H.reading_list(*load(s, d, "members", "articles", "feeds")).select("cluster_id", "article_id", "rn")


@query("h16_reading_text", f"""WITH {_RL}, qu AS (SELECT *, list_filter(regexp_extract_all(content, '"([^"]+)"', 1), lambda q: length(q) BETWEEN 31 AND 199)[1:2] AS q FROM rl)
    SELECT cluster_id, string_agg(rn || '. ' || coalesce(title, '') || chr(10) || left(coalesce(content, ''), 1500) || CASE WHEN len(q) > 0 THEN chr(10) || 'quotes: ' || array_to_string(q, ' / ') ELSE '' END, chr(10) || chr(10) ORDER BY rn) AS text FROM qu GROUP BY 1""", "members", "articles", "feeds")
def _(s, d):
    return H.reading_text(H.reading_list(*load(s, d, "members", "articles", "feeds")))


_FLAT = "fl AS (SELECT DISTINCT m.cluster_id, CASE h.category WHEN 'mitre_attack' THEN 'mitre' ELSE h.category END AS category, left(trim(h.matched), 500) AS name FROM members m JOIN hits h ON h.article_id = m.article_id)"


_AIW = " ".join(f"WHEN '{c}' THEN {w}" for c, w in H.AI_WEIGHTS.items())


def _flat(s, d):
    """Summary JSON of clusters, built from the dictionary hits, flattened again."""
    (m,) = load(s, d, "members")
    back = {v: k for k, v in H.RENAMES.items()}
    plural = F.coalesce(F.create_map(*(F.lit(x) for kv in back.items() for x in kv))[F.col("category")], F.col("category"))
    rows = m.select("cluster_id", "article_id").join(_hits(s, d).select("article_id", plural.alias("c"), "matched"), "article_id").groupBy("cluster_id", "c").agg(F.collect_set("matched").alias("names"))
    groups = rows.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "names"))).alias("m"))
    return H.summary_entities(groups.select("cluster_id", F.to_json(F.create_map(F.lit("found"), F.col("m"))).alias("entities")))


@query("h17_summary_entities", f"{HITS}, {_FLAT} SELECT cluster_id, category, name FROM fl", *_REP)
def _(s, d):
    return _flat(s, d)


@query("h18_sync_entities", f"{HITS}, {_FLAT} SELECT min(name) AS name, category, CASE category {_AIW} ELSE 50 END AS weight, 'ai_extracted' AS source FROM fl WHERE NOT EXISTS (SELECT 1 FROM dictionary d WHERE lower(d.name) = lower(fl.name) AND d.category = fl.category) GROUP BY lower(name), category", *_REP)
def _(s, d):
    return H.sync_entities(_flat(s, d), load(s, d, "dictionary")[0])


@query("h19_link_entities", f"{HITS}, {_FLAT}, lk AS (SELECT DISTINCT m.article_id, fl.name, fl.category FROM fl JOIN dictionary d ON d.name = fl.name AND d.category = fl.category JOIN members m ON m.cluster_id = fl.cluster_id WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.article_id = m.article_id AND h.name = fl.name AND h.category = fl.category)) SELECT *, count(*) OVER (PARTITION BY article_id) AS n_new FROM lk", *_REP)
def _(s, d):
    m, dic = load(s, d, "members", "dictionary")
    return H.link_entities(m, _flat(s, d), dic, _hits(s, d))


@query("h20_recent_summaries", f"SELECT cluster_id FROM clusters WHERE has_summary AND entities IS NOT NULL AND summary_at >= timestamp '{AS_OF}' - interval '162' hour", "clusters")
def _(s, d):
    return H.recent_summaries(load(s, d, "clusters")[0], AS_OF, 162).select("cluster_id")


@query("h21_needs_description", "SELECT entity_id FROM galaxy WHERE source = 'ai_extracted' AND category NOT IN ('cve', 'domain', 'ip_address', 'file_hash') AND trim(coalesce(description, '')) = '' ORDER BY entity_id DESC LIMIT 50", "galaxy")
def _(s, d):
    return H.needs_description(load(s, d, "galaxy")[0]).select("entity_id")


@query("h22_backfill_descriptions", "SELECT entity_id, coalesce(nullif(trim(description), ''), b) AS description FROM galaxy LEFT JOIN (SELECT article_id AS entity_id, content AS b FROM articles WHERE title <> '') USING (entity_id)", "galaxy", "articles")
def _(s, d):
    g, a = load(s, d, "galaxy", "articles")
    return H.backfill_descriptions(g, a.where("title <> ''").select(F.col("article_id").alias("entity_id"), F.col("content").alias("description"))).select("entity_id", "description")


@query("h23_keyword_effectiveness", f"WITH {_VAR}, {_KEY} SELECT variant AS keyword, count(*) AS n, round(avg(score), 6) AS mean FROM k5 JOIN rankings USING (article_id) WHERE rn <= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "articles", "keywords", "rankings")
def _(s, d):
    a, k, r = load(s, d, "articles", "keywords", "rankings")
    rows = G.keyword_score(a, G.keyword_variants(k)).select("article_id", F.explode("matches").alias("keyword")).join(r.select("article_id", "score"), "article_id")
    return H.effectiveness(rows, ["keyword"])


@query("h24_contributing_entities", f"{HITS} SELECT name, category, count(*) AS n, round(avg(score), 6) AS mean FROM hits JOIN rankings USING (article_id) WHERE weight >= 70 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", *_REP)
def _(s, d):
    a, dic, r = load(s, d, "articles", "dictionary", "rankings")
    rows = G.entity_score(E.match_dictionary(a, dic), dic).select("article_id", F.explode("contributing").alias("c")).select("article_id", "c.name", "c.category").join(r.select("article_id", "score"), "article_id")
    return H.effectiveness(rows, ["name", "category"])


@query("h25_ranking_report", f"""WITH {_MEAN}, best AS (SELECT mn.cluster_id FROM mn JOIN clusters c ON c.cluster_id = mn.cluster_id WHERE is_active ORDER BY mean DESC, mn.cluster_id LIMIT 5)
    SELECT cluster_id, article_id, score, rn FROM (SELECT m.cluster_id, m.article_id, score, row_number() OVER (PARTITION BY m.cluster_id ORDER BY score DESC, m.article_id) AS rn FROM members m JOIN rankings r ON r.article_id = m.article_id WHERE m.cluster_id IN (SELECT cluster_id FROM best)) WHERE rn <= 3""", "members", "rankings", "clusters")
def _(s, d):
    c, m, r = load(s, d, "clusters", "members", "rankings")
    return H.top_clusters_with_articles(c, m, r)


_TOPA = "SELECT r.article_id, r.score, title, strftime(published_at, {fmt}) AS published_at, f.name AS source, credibility FROM (SELECT * FROM rankings {where} ORDER BY score DESC, article_id LIMIT {k}) r JOIN articles a ON a.article_id = r.article_id JOIN feeds f ON f.feed_id = a.feed_id"


@query("h25_top_articles", _TOPA.format(fmt=FMT, where="", k=15), "rankings", "articles", "feeds")
def _(s, d):
    return H.top_ranked(*load(s, d, "articles", "rankings", "feeds")).withColumn("published_at", _ts("published_at"))


@query("h25_recent_high", _TOPA.format(fmt=FMT, where="WHERE recency_score > 50 AND score >= 60", k=10), "rankings", "articles", "feeds")
def _(s, d):
    return H.recent_high(*load(s, d, "articles", "rankings", "feeds")).withColumn("published_at", _ts("published_at"))


@query("h26_clustering_overview", "SELECT count(DISTINCT c.cluster_id) AS clusters, count(DISTINCT m.article_id) AS articles, count(DISTINCT feed) AS sources, round(avg(coherence), 6) AS coherence FROM members m JOIN articles a ON a.article_id = m.article_id JOIN clusters c ON c.cluster_id = m.cluster_id WHERE is_active", "members", "articles", "clusters")
def _(s, d):
    return H.clustering_overview(*load(s, d, "members", "articles", "clusters"))


@query("h27_f22_cluster_detail", f"{HITS} SELECT * FROM (SELECT cluster_id, name, category, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name, category) AS rn FROM (SELECT cluster_id, name, category, count(*) AS n FROM members m JOIN hits h ON h.article_id = m.article_id GROUP BY 1, 2, 3)) WHERE rn <= 10", *_REP)
def _(s, d):
    return H.frequent_entities(load(s, d, "members")[0], _hits(s, d))


@query("h27_cluster_detail", f"SELECT m.cluster_id, m.article_id, title, f.name AS source, strftime(published_at, {FMT}) AS published_at, is_primary, similarity, row_number() OVER (PARTITION BY m.cluster_id ORDER BY is_primary DESC, similarity DESC, m.article_id) AS rn FROM members m JOIN articles a ON a.article_id = m.article_id LEFT JOIN feeds f ON f.feed_id = a.feed_id", "members", "articles", "feeds")
def _(s, d):
    return H.cluster_detail(*load(s, d, "members", "articles", "feeds")).withColumn("published_at", _ts("published_at"))


@query("f22_entities_by_category", f"{HITS} SELECT * FROM (SELECT cluster_id, category, name, n, row_number() OVER (PARTITION BY cluster_id, category ORDER BY n DESC, name) AS rn FROM (SELECT cluster_id, name, category, count(*) AS n FROM members m JOIN hits h ON h.article_id = m.article_id GROUP BY 1, 2, 3)) WHERE rn <= 5", *_REP)
def _(s, d):
    return H.entities_by_category(load(s, d, "members")[0], _hits(s, d))


@query("h28_offtopic_feeds", "SELECT feed, count(DISTINCT m.article_id) AS articles, count(DISTINCT m.cluster_id) AS clusters FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id JOIN articles a ON a.article_id = m.article_id WHERE c.name LIKE '%1' OR c.name LIKE '%20%' GROUP BY 1", "members", "clusters", "articles")
def _(s, d):
    c, m, a = load(s, d, "clusters", "members", "articles")
    return H.offtopic_feeds(c, m, a, ("%1", "%20%"))


@query("h29_feed_summary", "SELECT category, count(*) AS feeds, round(avg(credibility), 6) AS credibility FROM feeds WHERE is_active GROUP BY 1", "feeds")
def _(s, d):
    return H.feed_summary(*load(s, d, "feeds"))


@query("h30_pipeline_status", " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) FILTER ({c} >= timestamp '{_CUT}' - interval '1' hour) AS last_hour, count(*) FILTER ({c} >= timestamp '{_CUT}' - interval '24' hour) AS last_day, count(*) AS total FROM {t}" for n, t, c in (("ingest", "articles", "published_at"), ("cluster", "members", "added_at"), ("summary", "clusters", "summary_at"))), "articles", "members", "clusters")
def _(s, d):
    a, m, c = load(s, d, "articles", "members", "clusters")
    return H.pipeline_status({"ingest": (a, "published_at"), "cluster": (m, "added_at"), "summary": (c, "summary_at")}, _CUT)


@query("h31_recent_results", """WITH re AS (SELECT 'article' AS kind, r.article_id AS id, title AS name, score, NULL::BIGINT AS articles FROM rankings r JOIN articles a ON a.article_id = r.article_id WHERE score >= 60 ORDER BY a.published_at DESC, r.article_id DESC LIMIT 10),
    cr AS (SELECT 'cluster' AS kind, c.cluster_id AS id, name, CAST(floor(round(avg(score) * 0.7 + coherence * 30, 6) + 0.5) AS INT) AS score, count(*) AS articles FROM clusters c JOIN rankings r ON c.cluster_id = r.cluster_id WHERE is_active GROUP BY c.cluster_id, name, coherence ORDER BY 4 DESC, 2 LIMIT 5)
    SELECT * FROM re UNION ALL SELECT * FROM cr""", "rankings", "articles", "clusters")
def _(s, d):
    return H.recent_results(*load(s, d, "articles", "rankings", "clusters"))


@query("h32_purge_counts", """WITH doom AS (SELECT article_id FROM articles WHERE feed_id IN (3, 7) OR contains(lower(title), 'onre'))
    SELECT 'members' AS name, count(*) AS removed FROM members WHERE article_id IN (SELECT article_id FROM doom) UNION ALL SELECT 'rankings', count(*) FROM rankings WHERE article_id IN (SELECT article_id FROM doom)
    UNION ALL SELECT 'articles', count(*) FROM articles WHERE article_id IN (SELECT article_id FROM doom) UNION ALL SELECT 'clusters', count(*) FROM clusters WHERE is_active AND cluster_id NOT IN (SELECT cluster_id FROM members WHERE article_id NOT IN (SELECT article_id FROM doom))""", "articles", "members", "rankings", "clusters")
def _(s, d):
    a, m, r, c = load(s, d, "articles", "members", "rankings", "clusters")
    doomed = a.where("feed_id IN (3, 7) OR contains(lower(title), 'onre')").select("article_id")
    _, left, counts = H.purge({"members": m, "rankings": r, "articles": a}, c, doomed)
    off = c.where("is_active").select("cluster_id").join(left.where("NOT is_active").select("cluster_id"), "cluster_id", "left_semi")
    return counts.unionByName(off.agg(F.count(F.lit(1)).alias("removed")).select(F.lit("clusters").alias("name"), "removed"))


@query("h33_check_summaries", """SELECT article_id, CASE WHEN trim(title) <> '' AND feed_id % 3 = 0 THEN true ELSE false END AS valid, CASE WHEN trim(title) <> '' AND feed_id % 3 = 0 THEN left(title, 4000) END AS summary_text, CASE WHEN trim(title) <> '' AND feed_id % 3 = 0 THEN 6 END AS n_insights, CASE WHEN trim(title) <> '' AND feed_id % 3 = 0 THEN 8 END AS n_ttps FROM articles""", "articles")
def _(s, d):
    a = load(s, d, "articles")[0].select("article_id", "feed_id", "title")
    good = F.to_json(F.struct(F.col("title").alias("summary"), F.array(*(F.lit(x) for x in "abcdefgh")).alias("key_insights"), F.array(*(F.lit(x) for x in "abcdefghij")).alias("ttps"), F.struct(F.col("feed_id").alias("feed")).alias("sources")))
    bad = F.to_json(F.struct("title", F.col("title").alias("summary"), F.array("title").alias("key_insights"), F.lit(7).alias("ttps"), F.struct("feed_id").alias("sources")))
    rows = a.withColumn("summary", F.when(F.col("feed_id") % 3 == 0, good).when(F.col("feed_id") % 3 == 1, bad).otherwise(F.concat(F.lit("{"), F.col("title"))))
    return H.check_summaries(rows).select("article_id", "valid", "summary_text", "n_insights", "n_ttps")


_H34 = "regexp_replace(regexp_replace(coalesce(content, '') || ' (see ' || article_id || ') (Citation: x) [y](http://z)..) end', '\\(Citation:[^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
for _ in range(3):  # pairs of brackets, the inner ones first
    _H34 = f"regexp_replace({_H34}, '\\(([^()]*)\\)', chr(1) || '\\1' || chr(2), 'g')"


@query("h34_clean_descriptions", f"""SELECT article_id, left(trim(regexp_replace(regexp_replace(replace(replace(replace({_H34}, ')', ''), chr(1), '('), chr(2), ')'), '\\s+', ' ', 'g'), '\\.{{2,}}', '.', 'g'), ' '), 500) AS description FROM articles""", "articles")
def _(s, d):
    text = F.concat(F.coalesce("content", F.lit("")), F.lit(" (see "), F.col("article_id").cast("string"), F.lit(") (Citation: x) [y](http://z)..) end"))
    return load(s, d, "articles")[0].select("article_id", H.clean_description(text).alias("description"))


@query("h35_source_freshness", f"SELECT 'feeds' AS source, strftime(max(published_at), {FMT}) AS latest FROM articles UNION ALL SELECT 'clusters', strftime(max(last_modified), {FMT}) FROM clusters", "articles", "clusters")
def _(s, d):
    a, c = load(s, d, "articles", "clusters")
    return H.source_freshness({"feeds": (a, "published_at"), "clusters": (c, "last_modified")}).select("source", _ts("latest"))


_SID = lambda kind, key: f"({kind} || '--' || regexp_replace(sha256({kind} || '|' || {key}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*$', '\\1-\\2-\\3-\\4-\\5'))"
_STIX = f"""nm AS (SELECT cluster_id, CASE WHEN category IN ('vulnerability', 'cve') THEN 'vulnerability' WHEN category IN ('apt_group', 'ransomware_group') THEN 'threat-actor' WHEN category = 'malware_family' THEN 'malware' WHEN category = 'mitre_attack' THEN 'attack-pattern' END AS obj_type, name, count(*) AS n
    FROM members m JOIN hits h ON h.article_id = m.article_id GROUP BY ALL),
ob AS (SELECT nm.cluster_id, obj_type, nm.name, {_SID('obj_type', 'nm.name')} AS obj_id FROM nm JOIN clusters c ON c.cluster_id = nm.cluster_id AND is_active WHERE obj_type IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY nm.cluster_id, obj_type ORDER BY n DESC, nm.name) <= CASE obj_type WHEN 'vulnerability' THEN 10 WHEN 'attack-pattern' THEN 1000 ELSE 5 END),
ed AS (SELECT a.cluster_id, 'relationship' AS obj_type, a.obj_id AS s, b.obj_id AS t, {_SID("'relationship'", 'a.obj_id || b.obj_id')} AS obj_id, CASE b.obj_type WHEN 'malware' THEN 'Threat actor uses malware' ELSE 'Threat actor uses technique' END AS x
    FROM ob a JOIN ob b ON a.cluster_id = b.cluster_id AND a.obj_type = 'threat-actor' AND b.obj_type IN ('malware', 'attack-pattern')),
pt AS (SELECT cluster_id, obj_type, obj_id, '{{"name":"' || name || '"}}' AS body FROM ob
    UNION ALL SELECT cluster_id, obj_type, obj_id, '{{"relationship_type":"uses","source_ref":"' || s || '","target_ref":"' || t || '","description":"' || x || '"}}' FROM ed),
rp AS (SELECT c.cluster_id, 'report' AS obj_type, {_SID("'report'", 'c.cluster_id::VARCHAR')} AS obj_id, '{{"name":"' || c.name || '","description":"","published":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '","confidence":80,"lang":"en","object_refs":[' || coalesce(refs, '') || ']}}' AS body
    FROM clusters c LEFT JOIN (SELECT cluster_id, string_agg(DISTINCT '"' || obj_id || '"', ',' ORDER BY '"' || obj_id || '"') AS refs FROM pt GROUP BY 1) r ON r.cluster_id = c.cluster_id WHERE is_active)"""


@query("a12_export_stix", f"{HITS}, {_STIX} SELECT cluster_id, obj_type, obj_id, body FROM rp UNION ALL SELECT cluster_id, obj_type, obj_id, body FROM pt", *_REP)
def _(s, d):
    c, m = load(s, d, "clusters", "members")
    return H.export_stix(c.where("is_active"), m, _hits(s, d))


# --- follows
_I1 = f"""i1 AS (SELECT * FROM (SELECT f.user_id, f.cluster_id, m.article_id, row_number() OVER (PARTITION BY f.user_id, f.cluster_id ORDER BY added_at DESC, m.article_id) AS rn FROM cluster_follows f JOIN members m ON m.cluster_id = f.cluster_id
    WHERE notify AND added_at > greatest(coalesce(last_notified_at, timestamp '{AS_OF}' - interval '168' hour), created_at) AND added_at <= timestamp '{AS_OF}') WHERE rn <= 10)"""
_FOL = ("cluster_follows", "members")


def _i1(s, d):
    return W.cluster_deltas(*load(s, d, *_FOL), AS_OF)


@query("i1_cluster_deltas", f"WITH {_I1} SELECT user_id, cluster_id, article_id, rn FROM i1", *_FOL)
def _(s, d):
    return _i1(s, d)


@query("i2_cluster_header", f"SELECT c.cluster_id, name, strftime(created_at, {FMT}) AS created_at, count(DISTINCT article_id) AS articles FROM clusters c LEFT JOIN members m ON m.cluster_id = c.cluster_id GROUP BY 1, 2, 3", "clusters", "members")
def _(s, d):
    return W.cluster_header(*load(s, d, "clusters", "members")).withColumn("created_at", _ts("created_at"))


_I3 = f"""bg AS (SELECT user_id, feed_id, coalesce(max(last_activity), timestamp '{_CUT}' - interval '24' hour) AS since FROM entity_follows WHERE notify GROUP BY 1, 2),
g3 AS (SELECT f.user_id, f.feed_id, h.article_id, published_at, string_agg(DISTINCT f.entity_id::VARCHAR, ',' ORDER BY f.entity_id::VARCHAR) AS ids, list(DISTINCT f.entity_id) AS idl FROM entity_follows f JOIN bg ON bg.user_id = f.user_id AND bg.feed_id = f.feed_id JOIN hits h ON h.entity_id = f.entity_id JOIN articles a ON a.article_id = h.article_id
       WHERE notify AND published_at > since AND published_at <= timestamp '{_CUT}' GROUP BY 1, 2, 3, 4),
i3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, feed_id ORDER BY published_at DESC, article_id) AS rn FROM g3) WHERE rn <= 20)"""
_ENF = ("entity_follows", "articles", "dictionary")


def _i3(s, d):
    f, a = load(s, d, "entity_follows", "articles")
    return W.entity_deltas(f, _some_hits(s, d), a, _CUT)


@query("i3_entity_deltas", f"{HITS}, {_I3} SELECT user_id, feed_id, article_id, rn, ids FROM i3", *_ENF)
def _(s, d):
    return _i3(s, d).select("user_id", "feed_id", "article_id", "rn", F.array_join(F.array_sort(F.transform("entity_ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query("i4_digest_by_entity", f"{HITS}, {_I3}, x4 AS (SELECT user_id, feed_id, unnest(idl) AS entity_id, article_id, published_at FROM i3) SELECT user_id, feed_id, entity_id, article_id, rn, greatest(0, n - 3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY user_id, feed_id, entity_id ORDER BY published_at DESC, article_id) AS rn, count(*) OVER (PARTITION BY user_id, feed_id, entity_id) AS n FROM x4) WHERE rn <= 3", *_ENF)
def _(s, d):
    return W.digest_by_entity(_i3(s, d))


@query("i5_advance_marks", f"WITH {_I1} SELECT f.user_id, f.cluster_id, strftime(CASE WHEN EXISTS (SELECT 1 FROM i1 WHERE i1.user_id = f.user_id AND i1.cluster_id = f.cluster_id) THEN timestamp '{AS_OF}' ELSE last_notified_at END, {FMT}) AS last_notified_at FROM cluster_follows f", *_FOL)
def _(s, d):
    rows = W.advance_marks(load(s, d, "cluster_follows")[0], _i1(s, d), ["user_id", "cluster_id"], "last_notified_at", AS_OF)
    return rows.select("user_id", "cluster_id", _ts("last_notified_at"))


@query("i6_delivery_log", f"WITH {_I1} SELECT user_id, cluster_id, count(*) AS articles, 'sent' AS status, '{AS_OF}' AS sent_at FROM i1 GROUP BY 1, 2", *_FOL)
def _(s, d):
    return W.delivery_log(_i1(s, d), AS_OF).select("user_id", "cluster_id", "articles", "status", _ts("sent_at"))


@query("i7_audience", "SELECT user_id, email FROM users u WHERE is_active AND email <> '' AND (daily_email OR EXISTS (SELECT 1 FROM cluster_follows f WHERE f.user_id = u.user_id AND notify))", "users", "cluster_follows")
def _(s, d):
    return W.audience(*load(s, d, "users", "cluster_follows"))


@query("i8_feeds_with_counts", "SELECT user_id, feed_id, count(DISTINCT entity_id) AS entities FROM entity_follows GROUP BY 1, 2", "entity_follows")
def _(s, d):
    return W.feeds_with_counts(*load(s, d, "entity_follows"))


@query("i9_most_followed", "SELECT f.cluster_id, count(DISTINCT user_id) AS followers, count(DISTINCT m.article_id) AS articles FROM cluster_follows f JOIN clusters c ON c.cluster_id = f.cluster_id JOIN members m ON m.cluster_id = f.cluster_id WHERE notify AND is_active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "cluster_follows", "clusters", "members")
def _(s, d):
    f, c, m = load(s, d, "cluster_follows", "clusters", "members")
    return W.most_followed(f, c, m)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
