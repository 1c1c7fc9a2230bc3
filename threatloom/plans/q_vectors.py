"""Queries of vectors, clusters and streams with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import vectors as V
from ..operators.similarity import sparse_similarity_join
from ..sources.shared import materialize, shared_dir
from ..streaming import stories as J
from .q_entities import _DICT
from .tables import AS_OF, load, with_views

Q: dict = {}
SQL: dict[str, str] = {}
T = 0.35


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def _vec(s, d):
    return load(s, d, "embeddings")[0].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


def _hits(s, d):
    return E.match_dictionary(*load(s, d, "articles", "dictionary"))


HITS = f"WITH {_DICT.strip()}"
_U = "u AS (SELECT vec_id AS id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_COS = "list_cosine_similarity(a.v, b.v)"
_EDGE = f"ed AS (SELECT a.id AS i, b.id AS j, {_COS} AS sim FROM u a JOIN u b ON a.id < b.id WHERE {_COS} >= {T})"
_COMP = "re(id, r) AS (SELECT i, i FROM ed UNION SELECT j, j FROM ed UNION SELECT e.b, re.r FROM re JOIN (SELECT i AS a, j AS b FROM ed UNION ALL SELECT j, i FROM ed) e ON e.a = re.id), lb AS (SELECT id, min(r) AS label FROM re GROUP BY 1)"


@query("f1_unclustered", f"{HITS} SELECT article_id FROM articles WHERE published_at >= timestamp '{AS_OF}' - interval '165' hour AND article_id IN (SELECT article_id FROM hits) AND article_id NOT IN (SELECT article_id FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id WHERE is_active)", "articles", "dictionary", "members", "clusters")
def _(s, d):
    a, m, c = load(s, d, "articles", "members", "clusters")
    return V.unclustered(a, _hits(s, d), m, c, AS_OF, 165).select("article_id")


@query("f2_vector_text", "SELECT article_id, coalesce(title, '') || ' ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '') AS text FROM articles", "articles")
def _(s, d):
    return load(s, d, "articles")[0].select("article_id", V.vector_text().alias("text"))


@query("f3_text_vectors", r"""WITH tk AS (SELECT article_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM articles),
    tf AS (SELECT article_id, term, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM articles)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    w AS (SELECT article_id, tf.term, tf * idf AS w FROM tf JOIN df ON df.term = tf.term), nm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT w.article_id, term, round(w / n, 6) AS weight FROM w JOIN nm ON nm.article_id = w.article_id""", "articles")
def _(s, d):
    return V.text_vectors(load(s, d, "articles")[0]).select("article_id", "term", F.round("weight", 6).alias("weight"))


@query("f4_similarity_join", f"WITH {_U}, {_EDGE} SELECT i, j, round(sim, 6) AS sim FROM ed")
def _(s, d):
    return V.similarity_join(_vec(s, d), T).select("i", "j", F.round("sim", 6).alias("sim"))


_SPARSE = r"""tk AS (SELECT article_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM articles),
    tf AS (SELECT article_id, term, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM articles)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    w AS (SELECT article_id, tf.term, tf * idf AS w FROM tf JOIN df ON df.term = tf.term), nm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1), uv AS (SELECT w.article_id, term, w / n AS x FROM w JOIN nm ON nm.article_id = w.article_id),
    sj AS (SELECT a.article_id AS i, b.article_id AS j, sum(a.x * b.x) AS sim FROM uv a JOIN uv b ON a.term = b.term AND a.article_id < b.article_id GROUP BY 1, 2)"""
SPARSE_T = 0.35


@query("f4_sparse", f"WITH {_SPARSE} SELECT i, j, round(least(1.0, sim), 6) AS sim FROM sj WHERE sim >= {SPARSE_T}", "articles")
def _(s, d):
    """The articles' TF-IDF vectors (F3), joined."""
    return sparse_similarity_join(V.text_vectors(load(s, d, "articles")[0]), SPARSE_T).select("i", "j", V.rounded("sim").alias("sim"))


@query("f5_representatives", f"SELECT m.cluster_id, min(article_id) AS article_id FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id WHERE is_primary AND is_active AND created_at >= timestamp '{AS_OF}' - interval '164' hour GROUP BY 1", "members", "clusters")
def _(s, d):
    c, m = load(s, d, "clusters", "members")
    return V.representatives(c, m, AS_OF, 164)


@query("f6_assign_nearest", f"""WITH {_U}, rp AS (SELECT label AS c, arg_min(v, id) AS v FROM u GROUP BY 1), sm AS (SELECT a.id, b.c, {_COS} AS sim FROM u a, rp b)
    SELECT id, arg_max(c, (sim, -c)) AS cluster_id, round(max(sim), 6) AS sim FROM sm GROUP BY 1 HAVING max(sim) >= 0.2""")
def _(s, d):
    vec = _vec(s, d)
    reps = vec.groupBy(F.col("label").alias("cluster_id")).agg(F.min_by("vec", "id").alias("vec"))
    return V.assign_nearest(vec.select("id", "vec"), reps, 0.2).select("id", "cluster_id", F.round("sim", 6).alias("sim"))


@query("f7_dbscan", f"WITH RECURSIVE {_U}, {_EDGE}, {_COMP} SELECT id, label FROM lb")
def _(s, d):
    return V.dbscan_vectors(_vec(s, d), T, 2)


@query("f7_dbscan_dense", f"""WITH RECURSIVE {_U}, {_EDGE}, nb AS (SELECT i AS a, j AS b FROM ed UNION SELECT j, i FROM ed), cr AS (SELECT a FROM nb GROUP BY 1 HAVING count(*) + 1 >= 4),
    ci AS (SELECT nb.a, nb.b FROM nb WHERE nb.a IN (SELECT a FROM cr) AND nb.b IN (SELECT a FROM cr)), rc(id, r) AS (SELECT a, a FROM cr UNION SELECT ci.b, rc.r FROM rc JOIN ci ON ci.a = rc.id),
    cl AS (SELECT id, min(r) AS label FROM rc GROUP BY 1) SELECT id, label FROM cl UNION ALL SELECT nb.a, min(label) FROM nb JOIN cl ON cl.id = nb.b WHERE nb.a NOT IN (SELECT a FROM cr) GROUP BY 1""")
def _(s, d):
    return V.dbscan_vectors(_vec(s, d), T, 4)


@query("f8_average_linkage")
def _(s, d):
    vec = _vec(s, d)
    return V.average_linkage(V.thin(V.linked(vec, T)).toDF("i", "j"), vec, T)[0]


@query("f9_cluster_articles")
def _(s, d):
    return V.cluster_articles(_vec(s, d), T)


_COH = f"""pr AS (SELECT a.label, least(1.0, greatest(0.0, {_COS})) AS sim FROM u a JOIN u b ON a.label = b.label AND a.id < b.id), co AS (SELECT label, avg(sim) AS coherence FROM pr GROUP BY 1), sz AS (SELECT label, count(*) AS size FROM u GROUP BY 1)"""


@query("f11_coherence", f"WITH {_U}, {_COH} SELECT sz.label, size::BIGINT AS size, round(coalesce(coherence, 1.0), 6) AS coherence FROM sz LEFT JOIN co ON co.label = sz.label")
def _(s, d):
    vec = _vec(s, d)
    return V.coherence(vec.select("id", "label"), vec.select("id", "vec")).select("label", "size", F.round("coherence", 6).alias("coherence"))


@query("f10_valid_clusters", f"WITH {_U}, {_COH} SELECT sz.label, size AS n FROM sz JOIN co ON co.label = sz.label WHERE size BETWEEN 2 AND 100000 AND coherence >= 0.02")
def _(s, d):
    vec = _vec(s, d)
    dates = vec.select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("published_at"))
    return V.valid_clusters(vec.select("id", "label"), dates, vec.select("id", "vec"), most=100_000, hours=1_000_000, threshold=0.02).select("label", "n")


_CEN = "dm AS (SELECT id, label, unnest(range(1, len(v) + 1)) AS k, unnest(v) AS x FROM u), cn AS (SELECT label, k, avg(x) AS m FROM dm GROUP BY 1, 2)"


@query("f12_primary_article", f"WITH {_U}, {_CEN}, ds AS (SELECT dm.label, id, round(sum((x - m) * (x - m)), 9) AS d FROM dm JOIN cn ON cn.label = dm.label AND cn.k = dm.k GROUP BY 1, 2) SELECT label, arg_min(id, (d, id)) AS id FROM ds GROUP BY 1")
def _(s, d):
    vec = _vec(s, d)
    return V.primary_article(vec.select("id", "label"), vec.select("id", "vec"))


@query("f13_member_similarity", f"WITH {_U}, {_CEN} SELECT dm.label, id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS similarity FROM dm JOIN cn ON cn.label = dm.label AND cn.k = dm.k GROUP BY 1, 2")
def _(s, d):
    vec = _vec(s, d)
    return V.member_similarity(vec.select("id", "label"), vec.select("id", "vec"))


_PROF = """ow AS (SELECT cluster_id, list_sort(list(DISTINCT m.article_id)) AS article_ids, list_sort(list(DISTINCT title)) AS titles, list_sort(list(DISTINCT feed)) AS feeds FROM members m JOIN articles a ON a.article_id = m.article_id GROUP BY 1),
en AS (SELECT cluster_id, list_sort(list(DISTINCT category || ':' || name)) AS entities FROM members m JOIN hits h ON h.article_id = m.article_id GROUP BY 1),
pf AS (SELECT ow.*, coalesce(entities, []) AS entities FROM ow LEFT JOIN en ON en.cluster_id = ow.cluster_id)"""
_REP = ("articles", "dictionary", "members", "clusters")


def _profiles(s, d):
    a, m, c = load(s, d, "articles", "members", "clusters")
    return V.cluster_profiles(m, a, _hits(s, d), c)


@query("f14_cluster_profiles", f"{HITS}, {_PROF} SELECT cluster_id, array_to_string(article_ids, ',') AS article_ids, array_to_string(feeds, ',') AS feeds, array_to_string(entities, ',') AS entities, array_to_string(titles, '|') AS titles FROM pf", *_REP)
def _(s, d):
    return _profiles(s, d).select("cluster_id", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ",").alias("article_ids"), F.array_join("feeds", ",").alias("feeds"), F.array_join("entities", ",").alias("entities"), F.array_join("titles", "|").alias("titles"))


_JAC = lambda c: f"CASE WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c}))) ELSE 0.0 END"
_DUP = f"""nw AS (SELECT p.* FROM pf p JOIN clusters c ON c.cluster_id = p.cluster_id WHERE NOT is_active), ex AS (SELECT p.* FROM pf p JOIN clusters c ON c.cluster_id = p.cluster_id WHERE is_active),
dp AS (SELECT a.cluster_id AS new_id, b.cluster_id AS old_id, round({_JAC('entities')}, 6) AS ent, round({_JAC('feeds')}, 6) AS src, {_JAC('article_ids')} AS art FROM nw a, ex b WHERE list_has_any(a.entities, b.entities))"""


def _sides(s, d):
    c = load(s, d, "clusters")[0]
    p = materialize(_profiles(s, d), "profiles")  # of both sides, so entities are looked for once
    return p.join(c.where("NOT is_active").select("cluster_id"), "cluster_id", "left_semi"), p.join(c.where("is_active").select("cluster_id"), "cluster_id", "left_semi")


def _dups(s, d):
    return V.duplicate_pairs(*_sides(s, d))


@query("f15_f16_overlaps", f"{HITS}, {_PROF}, {_DUP} SELECT new_id, old_id, art, ent, src FROM dp", *_REP)
def _(s, d):
    return V.overlaps(*_sides(s, d)).select("new_id", "old_id", "art", V.rounded("ent").alias("ent"), V.rounded("src").alias("src"))


_WEIGHT = "CASE split_part(e, ':', 1) " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in V.KEY_WEIGHTS.items()) + " ELSE 0.0 END"
_KEYS = lambda t: f"list_distinct(list_transform(list_filter({t}.entities, lambda e: {_WEIGHT} > 0), lambda e: lower(e)))"
_SUM = lambda x: f"coalesce(list_sum(list_transform({x}, lambda e: CAST({_WEIGHT} AS DOUBLE))), 0.0)"
_BOTH = f"{_SUM(f'list_intersect({_KEYS(chr(97))}, {_KEYS(chr(98))})')}"
_EVERY = f"{_SUM(f'list_distinct(list_concat({_KEYS(chr(97))}, {_KEYS(chr(98))}))')}"
_F19 = f"""nw AS (SELECT p.* FROM pf p JOIN clusters c ON c.cluster_id = p.cluster_id WHERE NOT is_active), ex AS (SELECT p.* FROM pf p JOIN clusters c ON c.cluster_id = p.cluster_id WHERE is_active),
ov AS (SELECT a.cluster_id AS new_id, b.cluster_id AS old_id, {_JAC('entities')} AS ent, {_JAC('feeds')} AS src, {_JAC('article_ids')} AS art, CASE WHEN {_EVERY} > 0 THEN {_BOTH} / {_EVERY} ELSE 0.0 END AS key FROM nw a, ex b WHERE {_JAC('entities')} >= 0.3),
gw AS (SELECT cluster_id, regexp_extract_all(lower(array_to_string(titles, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM pf),
gr AS (SELECT cluster_id, g, count(*)::DOUBLE AS n FROM (SELECT cluster_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM gw) GROUP BY 1, 2),
gq AS (SELECT cluster_id, sum(n * n) AS q FROM gr GROUP BY 1),
cm AS (SELECT new_id, old_id, sum(a.n * b.n) AS d, sum(a.n * a.n) AS cn, sum(b.n * b.n) AS cb FROM ov JOIN gr a ON a.cluster_id = new_id JOIN gr b ON b.cluster_id = old_id AND a.g = b.g GROUP BY 1, 2),
tl AS (SELECT ov.*, coalesce(d / sqrt((cn + pow(1 + ln(1.5), 2) * (x.q - cn)) * (cb + pow(1 + ln(1.5), 2) * (y.q - cb))), 0.0) AS ttl FROM ov LEFT JOIN cm ON cm.new_id = ov.new_id AND cm.old_id = ov.old_id LEFT JOIN gq x ON x.cluster_id = ov.new_id LEFT JOIN gq y ON y.cluster_id = ov.old_id),
bl AS (SELECT new_id, old_id, ttl, key, round(CASE WHEN key > 0.8 THEN 0.05 * art + 0.5 * ent + 0.3 * ttl + 0.05 * src + 0.1 * key ELSE 0.2 * art + 0.4 * ent + 0.3 * ttl + 0.1 * src END, 6) AS blend FROM tl),
du AS (SELECT *, blend >= CASE WHEN key > 0.8 THEN 0.65 ELSE 0.75 END AS duplicate FROM bl)"""


@query("f17_f19_duplicate_pairs", f"{HITS}, {_PROF}, {_F19} SELECT new_id, old_id, round(ttl, 6) AS ttl, round(key, 6) AS key, blend, duplicate FROM du", *_REP)
def _(s, d):
    return _dups(s, d).select("new_id", "old_id", V.rounded("ttl").alias("ttl"), V.rounded("key").alias("key"), "blend", "duplicate")


@query("f20_merge_clusters", f"{HITS}, {_PROF}, {_F19}, ft AS (SELECT new_id, min(old_id) AS t FROM du WHERE duplicate GROUP BY 1) SELECT c.cluster_id, coalesce(t, c.cluster_id) AS target, t IS NOT NULL AS merged FROM clusters c LEFT JOIN ft ON ft.new_id = c.cluster_id WHERE NOT is_active", *_REP)
def _(s, d):
    return V.merge_clusters(load(s, d, "clusters")[0].where("NOT is_active"), V.duplicate_pairs(*_sides(s, d), scored=False))


@query("f20_merge_counts", f"{HITS}, {_PROF}, {_F19}, ft AS (SELECT new_id, min(old_id) AS t FROM du WHERE duplicate GROUP BY 1) SELECT count(*) FILTER (t IS NULL) AS created, count(*) FILTER (t IS NOT NULL) AS merged, count(*) FILTER (t IS NOT NULL) AS prevented FROM clusters c LEFT JOIN ft ON ft.new_id = c.cluster_id WHERE NOT is_active", *_REP)
def _(s, d):
    return V.merge_counts(V.merge_clusters(load(s, d, "clusters")[0].where("NOT is_active"), V.duplicate_pairs(*_sides(s, d), scored=False)))


@query("f21_write_members", "SELECT 'member' AS kind, cluster_id, article_id, CASE WHEN similarity > 0.95 THEN similarity / 2 ELSE similarity END AS value FROM members UNION ALL SELECT 'cluster', cluster_id, NULL, greatest(coherence, CASE WHEN cluster_id % 2 = 0 THEN 0.9 ELSE 0.1 END) FROM clusters", "members", "clusters")
def _(s, d):
    """Existing pairs keep their similarity, half of the new one; clusters get the greater coherence."""
    m = load(s, d, "members")[0].select("cluster_id", "article_id", "similarity")
    c = load(s, d, "clusters")[0].select("cluster_id", "coherence")
    fresh = c.select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, 0.9).otherwise(0.1).alias("coherence"))
    rows, updated = V.write_members(m.where("similarity > 0.95").withColumn("similarity", F.col("similarity") / 2), m, c, fresh)
    out = rows.select(F.lit("member").alias("kind"), "cluster_id", "article_id", F.col("similarity").alias("value"))
    return out.unionByName(updated.select(F.lit("cluster").alias("kind"), "cluster_id", F.lit(None).cast("long").alias("article_id"), F.col("coherence").alias("value")))


_TW = r"""tw AS (SELECT cluster_id, m.article_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{4,}')) AS word FROM members m JOIN articles a ON a.article_id = m.article_id), cn AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1),
wf AS (SELECT tw.cluster_id, word, round(count(*) * (ln((1.0 + any_value(n)) / (1 + count(DISTINCT article_id))) + 1), 6) AS score FROM tw JOIN cn ON cn.cluster_id = tw.cluster_id GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, word) AS rn FROM wf) WHERE rn <= 3)"""


@query("f24_title_keywords", f"WITH {_TW} SELECT cluster_id, word, score, rn FROM kw", "members", "articles")
def _(s, d):
    return V.title_keywords(*load(s, d, "members", "articles"))


@query("f23_name_clusters", f"""{HITS}, {_TW}, ne AS (SELECT cluster_id, list_position(['apt_group', 'ransomware_group', 'malware_family', 'vulnerability', 'campaign', 'company'], category) AS p, name, count(*) AS n FROM members m JOIN hits h ON h.article_id = m.article_id WHERE weight >= 70 GROUP BY 1, 2, 3),
    n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, p ORDER BY n DESC, name) AS r2 FROM ne WHERE p > 0) WHERE r2 <= 2), n3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY p, n DESC, name) AS r3 FROM n2) WHERE r3 <= 3),
    nn AS (SELECT cluster_id, list(name ORDER BY r3) AS names FROM n3 GROUP BY 1), ww AS (SELECT cluster_id, list(word ORDER BY rn) AS words FROM kw GROUP BY 1),
    al AS (SELECT m.cluster_id, coalesce(names, []) AS names, coalesce(words, []) AS words FROM (SELECT DISTINCT cluster_id FROM members) m LEFT JOIN nn ON nn.cluster_id = m.cluster_id LEFT JOIN ww ON ww.cluster_id = m.cluster_id),
    fi AS (SELECT cluster_id, CASE WHEN len(names) >= 2 THEN names ELSE list_concat(names, words) END AS x FROM al) SELECT cluster_id, left(CASE WHEN len(x) > 0 THEN array_to_string(x, ' - ') ELSE 'cluster ' || cluster_id END, 200) AS name FROM fi""", *_REP)
def _(s, d):
    m, a = load(s, d, "members", "articles")
    return V.name_clusters(m, a, _hits(s, d))


@query("f25_cluster_summary", "SELECT cluster_id, coalesce(title, '') || chr(10) || left(coalesce(content, ''), 500) || '...' AS summary FROM members m JOIN articles a ON a.article_id = m.article_id WHERE is_primary", "members", "articles")
def _(s, d):
    return V.cluster_summary(*load(s, d, "members", "articles"))


@query("f26_run_clustering")
def _(s, d):
    vec = _vec(s, d).select("id", "vec")
    dates = vec.select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("published_at"))
    return V.run_clustering(vec, dates, AS_OF, 168, T)


# --- streams
def _stream(s, path: str, schema):
    """A table that is one file or a folder of files, as a stream."""
    if s.read.format("binaryFile").load(path).select("path").first()[0].rstrip("/").endswith(path.rsplit("/", 1)[-1]):  # the file itself
        return s.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[-1]).parquet(path.rsplit("/", 1)[0])
    return s.readStream.schema(schema).parquet(path)


def _events(s, d):
    return _stream(s, f"{d}/events.parquet", s.read.parquet(f"{d}/events.parquet").schema)


def _timed(s, d):
    return _events(s, d).withColumn("at", F.col("ts").cast("timestamp"))


def _folder(s) -> str:
    return f"{shared_dir(s)}/threatloom-stream-{uuid.uuid4().hex}"


@query("j1_stream_ingest", """SELECT url AS link FROM pages WHERE page_id % 3 <> 0 GROUP BY 1 HAVING url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL)""")
def _(s, d):
    """Pages as items, told to be on a breach so that all are relevant; those whose url is one of the stored third are known."""
    schema = s.read.parquet(f"{d}/pages.parquet").schema
    pages = _stream(s, f"{d}/pages.parquet", schema)
    title = F.concat(F.lit("Ransomware attack exploits critical vulnerability: "), F.regexp_extract("html", "<title>([^<]*)", 1))
    items = pages.where("page_id % 3 <> 0").select(title.alias("title"), F.lit("").alias("description"), F.col("url").alias("link"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 3600).alias("published_at"), F.lit("cybersecurity").alias("feed_category"))
    stored = load(s, d, "pages")[0].where("page_id % 3 = 0").select(F.col("url").alias("link"))
    return J.ingest_batches(items, ["x.com"], stored, _folder(s)).select("link")


@query("j2_route_late", "SELECT CASE WHEN ts < timestamp '2024-02-01 00:00:00' - interval '168' hour THEN 'late' ELSE 'kept' END AS sink, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    rows = J.route_late(_timed(s, d).select(F.col("at").alias("published_at")), "2024-02-01 00:00:00", 168, _folder(s))
    return rows.groupBy("sink").agg(F.sum("n").alias("n"))


@query("j3_stream_mentions", """WITH h AS (SELECT event_type AS name, date_trunc('hour', ts) - to_hours(unnest(range(0, 24))::INT) AS w FROM events)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, name, count(*) AS mentions FROM h WHERE w + interval '24' hour <= (SELECT max(ts) FROM events) - interval '1' hour GROUP BY 1, 2""")
def _(s, d):
    """The exact part of J3, beside its sketch of distinct articles."""
    rows = J.drain(J.stream_trending(_timed(s, d).select(F.col("event_type").alias("name"), F.col("user_id").alias("article_id"), "at")))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "name", "mentions")


@query("j3_stream_trending")
def _(s, d):
    rows = J.drain(J.stream_trending(_timed(s, d).select(F.col("event_type").alias("name"), F.col("user_id").alias("article_id"), "at")))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "name", "mentions", "articles")


@query("j4_stream_membership", "SELECT user_id AS cluster_id, count(*) AS article_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_modified FROM events GROUP BY 1")
def _(s, d):
    rows = J.drain(J.stream_membership(_timed(s, d).select(F.col("user_id").alias("cluster_id"), F.col("at").alias("added_at"))), "update")
    last = rows.groupBy("cluster_id").agg(F.max_by(F.struct("article_count", "last_modified"), "batch").alias("__r")).select("cluster_id", "__r.*")
    return last.select("cluster_id", "article_count", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


@query("j5_stream_follow", "SELECT user_id, user_id AS cluster_id, event_id AS article_id FROM events WHERE ts > timestamp '2024-01-10 00:00:00'")
def _(s, d):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)
    follows = load(s, d, "users")[0].select("user_id", (F.col("user_id") * 1).alias("cluster_id"), F.lit(True).alias("notify"), F.expr("timestamp '2024-01-10 00:00:00'").alias("created_at"))
    changes = _timed(s, d).select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("article_id"), F.col("at").alias("added_at"))
    return J.drain(J.stream_follow(changes, follows))


@query("j6_stream_status", """WITH h AS (SELECT event_type AS stage, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, stage, n FROM h WHERE w + interval '1' hour <= (SELECT max(ts) FROM events) - interval '1' hour""")
def _(s, d):
    rows = J.drain(J.stream_status(_timed(s, d).select(F.col("event_type").alias("stage"), "at"), "at"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n")


def _vector_stream(s, d):
    return _stream(s, f"{d}/embeddings.parquet", s.read.parquet(f"{d}/embeddings.parquet").schema)


@query("j7_stream_cluster")
def _(s, d):
    return J.stream_cluster(_vector_stream(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), T)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
