"""Queries of entities, indicators and knowledge with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import entities as E
from ..operators import ioc as I
from ..operators import knowledge as K
from .q_feeds import _quote
from .tables import load, with_views

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


_UNION = " UNION ALL ".join(
    f"SELECT article_id, unnest(regexp_extract_all(x, {_quote(p)})) AS name, '{c}' AS category, CAST({w} AS DOUBLE) AS confidence, {k} AS rank FROM tx" for k, (_, p, c, w) in enumerate(R.PATTERNS)
)
_PAT = f"tx AS (SELECT article_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '') AS x FROM articles), pat AS ({_UNION})"


def _net_sql(networks):
    out = []
    for net in networks:
        base, bits = net.split("/")
        first = 0
        for x in base.split("."):
            first = first * 256 + int(x)
        out.append(f"ip BETWEEN {first} AND {first + (1 << (32 - int(bits))) - 1}")
    return "(" + " OR ".join(out) + ")"


_IP = "CASE WHEN regexp_full_match({n}, '(?:0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])(?:\\.(?:0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])){{3}}') THEN split_part({n}, '.', 1)::BIGINT * 16777216 + split_part({n}, '.', 2)::BIGINT * 65536 + split_part({n}, '.', 3)::BIGINT * 256 + split_part({n}, '.', 4)::BIGINT END"
_LABEL = "regexp_extract(lower(n), '([a-z0-9-]+)\\.[a-z]{2,}$', 1)"
_in = lambda xs: "(" + ", ".join(map(_quote, xs)) + ")"
_VALID = f"""
vn AS (SELECT *, trim(name) AS n FROM pat), vi AS (SELECT *, {_IP.format(n='n')} AS ip FROM vn),
val AS (SELECT article_id, name, category, confidence, rank FROM vi WHERE n <> '' AND CASE category
  WHEN 'cve' THEN regexp_full_match(n, '(?i)CVE-\\d{{4}}-\\d{{4,}}') AND TRY_CAST(regexp_extract(n, '-(\\d{{4}})-', 1) AS INT) BETWEEN 1999 AND 2030
  WHEN 'ip_address' THEN ip IS NOT NULL AND NOT {_net_sql(R.ENTITY_NETWORKS)} AND n NOT IN {_in(R.KNOWN_IPS)}
  WHEN 'domain' THEN length(n) BETWEEN 4 AND 253 AND lower(n) NOT IN {_in(R.KNOWN_DOMAINS)} AND length({_LABEL}) > 1 AND NOT regexp_full_match({_LABEL}, '\\d+')
  WHEN 'file_hash' THEN regexp_full_match(n, '[a-fA-F0-9]{{32}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{64}}') AND replace(lower(n), substr(lower(n), 1, 1), '') <> ''
  WHEN 'email' THEN regexp_full_match(n, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') AND lower(n) NOT IN {_in(R.KNOWN_MAILS)}
  WHEN 'file_path' THEN length(n) BETWEEN 3 AND 500 AND (regexp_matches(n, '^[A-Za-z]:\\\\') AND NOT regexp_matches(n, '[<>"|?*]') OR starts_with(n, '/'))
  WHEN 'registry_key' THEN length(n) <= 500 AND contains(n, '\\')
  ELSE length(n) BETWEEN 2 AND 500 AND regexp_matches(n, '[a-zA-Z0-9]') END)"""
_TOK = r"[\p{L}\p{N}_]+"
_DICT = f"""
ph AS (SELECT entity_id, 0 AS rank, name AS matched FROM dictionary
       UNION ALL SELECT entity_id, i AS rank, string_split(synonyms, '|')[i] AS matched FROM (SELECT entity_id, synonyms, unnest(range(1, len(string_split(synonyms, '|')) + 1)) AS i FROM dictionary WHERE synonyms <> '')),
dt AS (SELECT article_id, lower(coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')) AS x FROM articles),
dw AS (SELECT article_id, x, regexp_extract_all(x, '{_TOK}') AS w FROM dt),
dg AS (SELECT DISTINCT article_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM dw),
dh AS (SELECT dg.article_id, ph.entity_id, arg_min(matched, rank) AS matched FROM dg JOIN ph ON dg.gram = lower(ph.matched) JOIN dt ON dt.article_id = dg.article_id AND contains(dt.x, lower(ph.matched)) GROUP BY 1, 2),
hits AS (SELECT article_id, dh.entity_id, name, category, weight, matched FROM dh JOIN dictionary d ON d.entity_id = dh.entity_id)"""


def _patterns(s, d):
    return E.extract_patterns(load(s, d, "articles")[0])


def _hits(s, d):
    return E.match_dictionary(*load(s, d, "articles", "dictionary"))


@query("c1_extract_patterns", f"WITH {_PAT} SELECT article_id, name, category, confidence FROM pat", "articles")
def _(s, d):
    return _patterns(s, d).select("article_id", "name", "category", "confidence")


@query("c2_c6_valid_entities", f"WITH {_PAT}, {_VALID} SELECT article_id, name, category FROM val", "articles")
def _(s, d):
    return E.valid_entities(_patterns(s, d)).select("article_id", "name", "category")


@query("c7_code_context", r"SELECT page_id, regexp_replace(coalesce(html, ''), '(?i)```[\s\S]*?```|<code>[\s\S]*?</code>|<pre>[\s\S]*?</pre>|example:[\s\S]*?\n\n|demo:[\s\S]*?\n\n', ' ', 'g') AS html FROM pages")
def _(s, d):
    return E.drop_code_context(load(s, d, "pages")[0], "html").select("page_id", "html")


@query("c8_match_dictionary", f"WITH {_DICT.strip()} SELECT article_id, entity_id, name, category, weight, matched FROM hits", "articles", "dictionary")
def _(s, d):
    return _hits(s, d)


_BOOST = """bx AS (SELECT article_id, lower(coalesce(title, '')) AS h, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS x FROM articles),
bt AS (SELECT v.*, contains(h, lower(name)) AS head, (length(x) - length(replace(x, lower(name), ''))) / length(lower(name)) AS times FROM val v JOIN bx USING (article_id)),
bo AS (SELECT article_id, name, category, rank, round(least(1.0, confidence + CASE WHEN head THEN 0.05 ELSE 0 END + CASE WHEN times > 1 THEN least(0.03 * (times - 1), 0.1) ELSE 0 END), 6) AS confidence,
       CASE WHEN head THEN 'title' ELSE 'content' END AS position FROM bt)"""


@query("c9_boost_confidence", f"WITH {_PAT}, {_VALID}, {_BOOST} SELECT article_id, name, category, confidence, position FROM bo", "articles")
def _(s, d):
    (a,) = load(s, d, "articles")
    return E.boost_confidence(E.valid_entities(E.extract_patterns(a)), a).select("article_id", "name", "category", "confidence", "position")


_ALL = """al AS (SELECT article_id, name, category, confidence, 'regex' AS method, rank FROM val UNION ALL SELECT article_id, name, category, 0.95, 'predefined', entity_id FROM hits),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, lower(name), category ORDER BY CASE method WHEN 'regex' THEN 0 ELSE 1 END, rank, name) AS rn FROM al) WHERE rn = 1)"""


def _deduped(s, d):
    p = E.valid_entities(_patterns(s, d)).select("article_id", "name", "category", "confidence", F.lit("regex").alias("method"), F.col("rank").cast("long"))
    h = _hits(s, d).select("article_id", "name", "category", F.lit(0.95).alias("confidence"), F.lit("predefined").alias("method"), F.col("entity_id").alias("rank"))
    return E.dedup_entities(p.unionByName(h))


@query("c10_dedup_entities", f"WITH {_PAT}, {_VALID}, {_DICT.strip()}, {_ALL} SELECT article_id, name, category, confidence, method FROM de", "articles", "dictionary")
def _(s, d):
    return _deduped(s, d).select("article_id", "name", "category", "confidence", "method")


@query("c11_pack_entities", f"""WITH {_PAT}, {_VALID}, {_DICT.strip()}, {_ALL} SELECT article_id, string_agg(category || ':' || name, '|' ORDER BY category, name, confidence) AS entities, count(*) AS entity_count,
    (SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT category AS c FROM de e WHERE e.article_id = de.article_id)) AS categories FROM de GROUP BY article_id""", "articles", "dictionary")
def _(s, d):
    rows = E.pack_entities(_deduped(s, d))
    return rows.select("article_id", F.array_join(F.transform("entities", lambda e: F.concat(e["category"], F.lit(":"), e["name"])), "|").alias("entities"), "entity_count", F.array_join("categories", "|").alias("categories"))


_CAP = "CASE WHEN length(name) <= 500 THEN name WHEN category IN ('file_path', 'registry_key') THEN '...' || right(name, 497) ELSE left(name, 497) || '...' END"


@query("c12_discover_entities", f"""WITH {_PAT}, {_VALID}, cp AS (SELECT DISTINCT {_CAP} AS name, category FROM val)
    SELECT name, category, CASE category WHEN 'cve' THEN 80 WHEN 'file_hash' THEN 60 WHEN 'ip_address' THEN 55 WHEN 'domain' THEN 50 ELSE 50 END AS weight, 'dynamic' AS source FROM cp
    WHERE NOT EXISTS (SELECT 1 FROM dictionary d WHERE d.name = cp.name AND d.category = cp.category)""", "articles", "dictionary")
def _(s, d):
    return E.discover_entities(E.valid_entities(_patterns(s, d)), load(s, d, "dictionary")[0])


@query("c13_cap_name", f"WITH {_PAT} SELECT article_id, {_CAP} AS name, category FROM pat", "articles")
def _(s, d):
    return _patterns(s, d).select("article_id", E.cap_name(F.col("name"), F.col("category")).alias("name"), "category")


@query("c15_extraction_stats", f"WITH {_DICT.strip()} SELECT category, count(*) AS entities, count(DISTINCT article_id) AS articles FROM hits GROUP BY ROLLUP (category)", "articles", "dictionary")
def _(s, d):
    return E.extraction_stats(_hits(s, d))


_NEWDICT = f"nd AS (SELECT row_number() OVER (ORDER BY category, name) AS entity_id, name, category, CASE category WHEN 'cve' THEN 80 WHEN 'file_hash' THEN 60 WHEN 'ip_address' THEN 55 ELSE 50 END AS weight, method AS source FROM (SELECT DISTINCT name, category, method FROM de))"


@query("c14_synonym_table", f"""WITH {_PAT}, {_VALID}, {_DICT.strip()}, hn AS (SELECT DISTINCT h.entity_id, h.matched, d.synonyms FROM hits h JOIN dictionary d ON d.entity_id = h.entity_id), sy AS (SELECT entity_id, matched AS synonym FROM hn UNION SELECT entity_id, unnest(string_split(synonyms, '|')) FROM hn) SELECT entity_id, synonym, lower(synonym) AS synonym_lower FROM sy WHERE synonym <> ''""", "articles", "dictionary")
def _(s, d):
    """The names that articles use, each with the synonyms of its dictionary entry."""
    names = _hits(s, d).select("entity_id", F.col("matched").alias("name")).distinct().join(load(s, d, "dictionary")[0].select("entity_id", "synonyms"), "entity_id")
    return E.synonym_table(names)


@query("c16_dictionary_stats", f"WITH {_PAT}, {_VALID}, {_DICT.strip()}, {_ALL}, nd AS (SELECT DISTINCT name, category, method AS source FROM de) SELECT source, category, count(*) AS n, max(length(name))::BIGINT AS max_weight FROM nd GROUP BY ROLLUP (source, category)", "articles", "dictionary")
def _(s, d):
    nd = _deduped(s, d).select("name", "category", F.col("method").alias("source"), F.length("name").cast("long").alias("weight")).distinct()
    return E.dictionary_stats(nd)


@query("c16_latest_entries", f"WITH {_PAT}, {_VALID} SELECT DISTINCT article_id AS entity_id FROM val ORDER BY article_id DESC LIMIT 10", "articles")
def _(s, d):
    return E.latest_entries(E.valid_entities(_patterns(s, d)).select(F.col("article_id").alias("entity_id")).distinct())


# --- indicators
_TAB = r"""hd AS (SELECT feed, min(line_no) AS h FROM ioc_lines WHERE starts_with(line, '#fields') GROUP BY feed),
tl AS (SELECT feed, trim(split_part(trim(line, ' '), chr(9), 1), ' ') AS ioc, trim(split_part(trim(line, ' '), chr(9), 2), ' ') AS kind, trim(line, ' ') AS line FROM ioc_lines JOIN hd USING (feed) WHERE line_no > h),
tab AS (SELECT feed, ioc, 'ip_address' AS ioc_type FROM tl WHERE line <> '' AND NOT starts_with(line, '#') AND ioc <> '' AND CASE WHEN kind = '' THEN regexp_full_match(ioc, '(\d{1,3}\.){3}\d{1,3}') ELSE kind IN ('Intel::ADDR', 'Intel::SUBNET') END)"""
_PLAIN = r"""pl AS (SELECT feed, trim(line, ' ') AS l FROM plain_lines), pla AS (SELECT feed, trim(regexp_replace(split_part(split_part(l, ' ', 1), ',', 1), '["'']', '', 'g'), ' ') AS ioc, 'domain' AS ioc_type FROM pl WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '//'))"""
_LAB = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_NORM = f"""raw AS (SELECT * FROM tab UNION ALL SELECT * FROM pla),
nx AS (SELECT feed, ioc_type, ioc, {_IP.format(n='ioc')} AS ip, split_part(split_part(regexp_replace(lower(ioc), '^https?://', ''), '/', 1), ':', 1) AS dom FROM raw),
nv AS (SELECT feed, ioc_type, CASE ioc_type WHEN 'ip_address' THEN CASE WHEN ip IS NOT NULL AND NOT {_net_sql(R.IOC_NETWORKS)} THEN ioc END ELSE
   CASE WHEN regexp_full_match(dom, '{_LAB}(?:\\.{_LAB})+') AND length(dom) >= 3 AND dom NOT IN {_in(R.IOC_DOMAINS)} AND regexp_extract(dom, '([^.]+)$', 1) NOT IN {_in(R.IOC_TLDS)} AND NOT regexp_full_match(dom, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}') THEN dom END END AS ioc FROM nx),
ok AS (SELECT * FROM nv WHERE ioc IS NOT NULL), dd AS (SELECT DISTINCT feed, ioc_type, ioc FROM ok),
co AS (SELECT ioc_type, ioc, count(*) AS n_feeds, string_agg(feed, '|' ORDER BY feed) AS feeds FROM dd GROUP BY 1, 2),
im AS (SELECT *, CASE WHEN n_feeds >= 4 THEN 75 WHEN n_feeds = 3 THEN 65 ELSE 50 END AS weight FROM co)"""
_IOC = f"WITH {_TAB}, {_PLAIN}, {_NORM}"


def _raw(s, d):
    lines, plain = load(s, d, "ioc_lines", "plain_lines")
    return I.read_tab_intel(lines, "ip_address").unionByName(I.read_plain_intel(plain, "domain"))


def _corroborated(s, d, n=1):
    return I.ioc_importance(I.corroborate(I.dedup_iocs(I.validate_iocs(_raw(s, d))), n))


@query("a5_tab_intel", f"WITH {_TAB} SELECT feed, ioc, ioc_type FROM tab", "ioc_lines")
def _(s, d):
    return I.read_tab_intel(load(s, d, "ioc_lines")[0], "ip_address")


@query("a6_plain_intel", f"WITH {_PLAIN} SELECT feed, ioc, ioc_type FROM pla", "plain_lines")
def _(s, d):
    return I.read_plain_intel(load(s, d, "plain_lines")[0], "domain")


@query("d1_validate_iocs", f"{_IOC} SELECT feed, ioc_type, ioc FROM ok", "ioc_lines", "plain_lines")
def _(s, d):
    return I.validate_iocs(_raw(s, d)).select("feed", "ioc_type", "ioc")


@query("d2_dedup_iocs", f"{_IOC} SELECT feed, ioc_type, ioc FROM dd", "ioc_lines", "plain_lines")
def _(s, d):
    return I.dedup_iocs(I.validate_iocs(_raw(s, d))).select("feed", "ioc_type", "ioc")


@query("d3_corroborate", f"{_IOC} SELECT ioc_type, ioc, feeds FROM co WHERE n_feeds >= 2", "ioc_lines", "plain_lines")
def _(s, d):
    return _corroborated(s, d, 2).select("ioc_type", "ioc", F.array_join("feeds", "|").alias("feeds"))


@query("d4_ioc_importance", f"{_IOC} SELECT ioc_type, ioc, weight FROM im", "ioc_lines", "plain_lines")
def _(s, d):
    return _corroborated(s, d).select("ioc_type", "ioc", "weight")


@query("d5_merge_iocs", f"""{_IOC}, old AS (SELECT ioc AS name, ioc_type AS category, 10 AS weight, 'manual' AS source FROM co WHERE n_feeds = 1 UNION ALL SELECT name, category, weight, source FROM dictionary)
    SELECT coalesce(old.name, im.ioc) AS name, coalesce(old.category, im.ioc_type) AS category, coalesce(im.weight, old.weight)::INT AS weight, CASE WHEN im.ioc IS NOT NULL THEN 'ioc_feeds' ELSE source END AS source
    FROM old FULL JOIN im ON old.name = im.ioc AND old.category = im.ioc_type""", "ioc_lines", "plain_lines", "dictionary")
def _(s, d):
    im = _corroborated(s, d)
    empty = F.array().cast("array<string>").alias("feeds")
    old = im.where(F.size("feeds") == 1).select(F.col("ioc").alias("name"), F.col("ioc_type").alias("category"), F.lit(10).alias("weight"), F.lit("manual").alias("source"), empty)
    old = old.unionByName(load(s, d, "dictionary")[0].select("name", "category", "weight", "source", empty))
    return I.merge_iocs(old, im).select("name", "category", "weight", "source")


@query("d6_ioc_run_stats", f"""{_IOC}, fe AS (SELECT DISTINCT feed, 'ip_address' AS ioc_type FROM ioc_lines UNION ALL SELECT DISTINCT feed, 'domain' FROM plain_lines),
    al AS (SELECT ioc_type, 1 AS f, 0 AS v, 0 AS s, 0 AS p, 0 AS e FROM raw UNION ALL SELECT ioc_type, 0, 1, 0, 0, 0 FROM ok UNION ALL SELECT ioc_type, 0, 0, 1, 0, 0 FROM co UNION ALL SELECT ioc_type, 0, 0, 0, (length(feed) % 2 = 1)::INT, (length(feed) % 2 = 0)::INT FROM fe)
    SELECT ioc_type, sum(f)::BIGINT AS fetched, sum(v)::BIGINT AS validated, sum(s)::BIGINT AS stored, sum(p)::BIGINT AS feeds_processed, sum(e)::BIGINT AS feeds_failed FROM al GROUP BY ROLLUP (ioc_type)""", "ioc_lines", "plain_lines")
def _(s, d):
    """Feeds of an even length count as failed."""
    raw = _raw(s, d)
    lines, plain = load(s, d, "ioc_lines", "plain_lines")
    fetches = lines.select(F.lit("ip_address").alias("ioc_type"), "feed").distinct().unionByName(plain.select(F.lit("domain").alias("ioc_type"), "feed").distinct())
    fetches = fetches.withColumn("error", F.when(F.length("feed") % 2 == 0, "timeout"))
    return I.ioc_run_stats(raw, I.validate_iocs(raw), _corroborated(s, d), fetches)


@query("d7_ioc_inventory", f"""{_IOC} SELECT 'category' AS kind, ioc_type AS name, count(*) AS n FROM co GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM co
    UNION ALL SELECT * FROM (SELECT 'feed', feed, count(*) FROM dd GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""", "ioc_lines", "plain_lines")
def _(s, d):
    return I.ioc_inventory(_corroborated(s, d))


# --- knowledge
@query("a4_dictionary_load", "SELECT title AS name, feed AS category, max(score)::INT AS weight FROM (SELECT title, feed, length(content) AS score, row_number() OVER (PARTITION BY title, feed ORDER BY article_id DESC) AS rn FROM articles WHERE title <> '') WHERE rn = 1 GROUP BY 1, 2", "articles")
def _(s, d):
    rows = load(s, d, "articles")[0].select(F.col("title").alias("name"), F.col("feed").alias("category"), F.length("content").alias("weight"), F.lit("manual").alias("source"), F.col("article_id").alias("row_no"))
    return K.keep_last(rows).select("name", "category", "weight")


@query("a7_galaxy", "SELECT DISTINCT trim(title) AS name, 'apt_group' AS category, 50 AS weight, 'misp' AS source, feed AS synonym, article_id FROM articles WHERE trim(title) <> ''", "articles")
def _(s, d):
    """Feeds as galaxy documents: one ``values`` element an article."""
    meta = F.struct(F.array("feed").alias("synonyms"), F.array().cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("country"))
    value = F.struct(F.col("title").alias("value"), F.lit(None).cast("string").alias("uuid"), F.col("article_id").cast("string").alias("description"), meta.alias("meta"))
    docs = load(s, d, "articles")[0].select(F.array(value).alias("values"))
    return K.galaxy_rows(docs, "apt_group").select("name", "category", "weight", "source", F.col("synonyms")[0].alias("synonym"), F.col("description").cast("long").alias("article_id"))


@query("a8_e2_attack_bundle", """
    SELECT technique_id, arg_max(name, article_id) AS name, arg_max(platforms, article_id) AS platform, arg_max(article_id, article_id) % 2 = 1 AS is_subtechnique, 'initial' AS phase
    FROM bundle WHERE NOT revoked GROUP BY technique_id""", "bundle")
def _(s, d):
    """The bundle view as documents of one object each; repeated ids are kept apart by their id's place."""
    b = load(s, d, "bundle")[0]
    ref = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique_id").alias("external_id"), F.lit(None).cast("string").alias("url")))
    phase = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lit("initial").alias("phase_name")), F.struct(F.lit("other").alias("kill_chain_name"), F.lit("x").alias("phase_name")))
    none = F.lit(None).cast("string")
    one = F.struct(
        F.lit("attack-pattern").alias("type"), none.alias("id"), "name", "description", "revoked", ref.alias("external_references"), phase.alias("kill_chain_phases"),
        F.array("platforms").alias("x_mitre_platforms"), F.lit(None).cast("array<string>").alias("x_mitre_data_sources"), none.alias("x_mitre_detection"), (F.col("article_id") % 2 == 1).alias("x_mitre_is_subtechnique"), "article_id",
    )
    docs = b.groupBy("technique_id").agg(F.array_sort(F.collect_list(F.struct("article_id", one.alias("o")))).alias("l")).select(F.transform("l", lambda x: x["o"]).alias("objects"))
    return K.technique_rows(docs).select("technique_id", "name", F.col("platforms")[0].alias("platform"), "is_subtechnique", F.array_join("phases", ",").alias("phase"))


_TID = lambda c: f"nullif(regexp_extract(coalesce({c}, ''), '^(T\\d{{4}}(?:\\.\\d{{3}})?)(?:\\s|$)', 1), '')"


@query("e1_technique_id", f"SELECT entity_id, coalesce({_TID('value')}, {_TID('name')}) AS technique_id FROM galaxy", "galaxy")
def _(s, d):
    return K.with_technique_id(load(s, d, "galaxy")[0]).select("entity_id", "technique_id")


@query("e3_new_techniques", f"""SELECT technique_id, name FROM bundle b WHERE NOT EXISTS (SELECT 1 FROM galaxy g WHERE coalesce({_TID('g.value')}, {_TID('g.name')}) = b.technique_id)
    AND NOT EXISTS (SELECT 1 FROM galaxy g WHERE lower(g.name) = lower(b.name))""", "bundle", "galaxy")
def _(s, d):
    b, g = load(s, d, "bundle", "galaxy")
    return K.new_techniques(b, g).select("technique_id", "name")


_FILL = ", ".join(f"coalesce({f'nullif(g.{c}, {chr(39) * 2})' if c in K.FILLED[:2] else f'g.{c}'}, CASE WHEN b1.technique_id IS NOT NULL THEN b1.x.{c} WHEN b2.technique_id IS NOT NULL THEN b2.x.{c} ELSE bn.x.{c} END) AS {c}" for c in K.FILLED)
_PACK = "{" + ", ".join(f"'{c}': {c}" for c in K.FILLED) + "}"


@query("e4_merge_techniques", f"""WITH bi AS (SELECT technique_id, arg_max({_PACK}, article_id) AS x FROM bundle GROUP BY 1), bn AS (SELECT lower(name) AS l, arg_max({_PACK}, technique_id) AS x FROM bundle GROUP BY 1)
    SELECT g.entity_id, {_FILL}, b1.technique_id IS NOT NULL OR b2.technique_id IS NOT NULL OR l IS NOT NULL AS merged
    FROM galaxy g LEFT JOIN bi b1 ON b1.technique_id = {_TID('g.value')} LEFT JOIN bi b2 ON b2.technique_id = {_TID('g.name')} LEFT JOIN bn ON bn.l = lower(g.name)""", "bundle", "galaxy")
def _(s, d):
    b, g = load(s, d, "bundle", "galaxy")
    return K.merge_techniques(g, b).select("entity_id", *K.FILLED, "merged")


@query("e5_upsert_knowledge", """WITH old AS (SELECT technique_id AS name, 'mitre_attack' AS category, min(article_id)::INT AS weight, '{"id":"' || technique_id || '"}' AS doc, 'initial' AS source FROM bundle WHERE NOT revoked GROUP BY 1),
    new AS (SELECT value AS name, 'mitre_attack' AS category, max(entity_id)::INT AS weight, '{"first":' || min(entity_id) || ',"last":' || max(entity_id) || '}' AS doc, 'misp' AS source FROM galaxy GROUP BY 1)
    SELECT coalesce(old.name, new.name) AS name, coalesce(old.category, new.category) AS category, coalesce(new.weight, old.weight) AS weight, coalesce(new.doc, old.doc) AS doc, coalesce(new.source, old.source) AS source FROM old FULL JOIN new ON old.name = new.name""", "bundle", "galaxy")
def _(s, d):
    b, g = load(s, d, "bundle", "galaxy")
    old = b.where("NOT revoked").groupBy(F.col("technique_id").alias("name")).agg(F.lit("mitre_attack").alias("category"), F.min("article_id").cast("int").alias("weight"))
    old = old.withColumns({"doc": F.to_json(F.struct(F.col("name").alias("id"))), "source": F.lit("initial")})
    new = g.groupBy(F.col("value").alias("name")).agg(F.lit("mitre_attack").alias("category"), F.max("entity_id").cast("int").alias("weight"), F.to_json(F.struct(F.min("entity_id").alias("first"), F.max("entity_id").alias("last"))).alias("doc"), F.lit("misp").alias("source"))
    return K.upsert_knowledge(old, new)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
