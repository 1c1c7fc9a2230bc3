"""Small fixtures with hand-made results."""

import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from threatloom.functions import rules as R
from threatloom.operators import entities as E
from threatloom.operators import feeds as O
from threatloom.operators import follows as W
from threatloom.operators import ioc as I
from threatloom.operators import knowledge as K
from threatloom.operators import ranking as G
from threatloom.operators import reports as H
from threatloom.operators import text as T
from threatloom.operators import vectors as V
from threatloom.operators.graph import components
from threatloom.sources.upsert import upsert
from threatloom.streaming import stories as J

AS_OF = "2024-01-02 00:00:00"


def test_recency(spark):
    hours = [0, 1, 6, 12, 24, 48, None]
    start = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(i, None if h is None else start - dt.timedelta(hours=h)) for i, h in enumerate(hours)], "i int, published_at timestamp")
    got = [r.s for r in rows.select("i", F.round(G.recency_score(F.col("published_at"), AS_OF), 4).alias("s")).orderBy("i").collect()]
    assert got == [100, 95.8333, 75, 50, 0, 0, 0]


def test_keyword_score(spark):
    rules = spark.createDataFrame([(1, "x", "alpha", 100), (2, "x", "beta_two", 50)], "rule_no int, category string, keyword string, weight int")
    articles = spark.createDataFrame([(1, "Alpha news", "about beta two"), (2, None, None)], "article_id long, title string, content string")
    got = {r.article_id: r.keyword_severity for r in G.keyword_score(articles, G.keyword_variants(rules)).collect()}
    assert got == {1: 62.5, 2: 0.0}


def test_entity_score(spark):
    d = spark.createDataFrame([("a", "x", 90), ("b", "x", 85), ("c", "x", 80)], "name string, category string, weight int")
    hits = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (2, "z", "x")], "article_id long, name string, category string")
    assert {r.article_id: r.entity_importance for r in G.entity_score(hits, d).collect()} == {1: 100, 2: 50}


def test_patterns(spark):
    texts = [
        ("The vulnerability CVE-2023-12345 was discovered in the system.", {("cve", "CVE-2023-12345")}),
        ("connects to 185.220.101.45 and downloads from evil-malware.com", {("ip_address", "185.220.101.45"), ("domain", "evil-malware.com")}),
        ("File hash: d41d8cd98f00b204e9800998ecf8427e", {("file_hash", "d41d8cd98f00b204e9800998ecf8427e")}),
        ("Bitcoin wallet: 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", {("cryptocurrency", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")}),
        (r"Registry key: HKEY_LOCAL_MACHINE\Software\Microsoft\Run", {("registry_key", r"HKEY_LOCAL_MACHINE\Software\Microsoft\Run")}),
    ]
    df = spark.createDataFrame([(i, "", t) for i, (t, _) in enumerate(texts)], "article_id long, title string, content string")
    got = {}
    for r in E.valid_entities(E.extract_patterns(df)).collect():
        got.setdefault(r.article_id, set()).add((r.category, r.name))
    for i, (_, want) in enumerate(texts):
        assert want <= got[i]


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = [
        ("CVE-2023-12345", "cve", True), ("CVE-1999-0001", "cve", True), ("8.8.8.8", "ip_address", True), ("evil-malware.com", "domain", True), ("security.microsoft.com", "domain", True),
        ("d41d8cd98f00b204e9800998ecf8427e", "file_hash", True), ("user@example.org", "email", True), ("google.com", "domain", False), ("example.com", "domain", False), ("test.com", "domain", False),
        ("CVE-1998-12345", "cve", False), ("invalid-cve", "cve", False), ("192.168.1.1", "ip_address", False), ("10.0.0.1", "ip_address", False), ("999.999.999.999", "ip_address", False),
        ("0" * 32, "file_hash", False), ("F" * 32, "file_hash", False), ("notahash", "file_hash", False), ("user@example.com", "email", False), ("01.2.3.4", "ip_address", False), ("", "tool", False), (None, "cve", False),
    ]
    df = spark.createDataFrame(cases, "name string, category string, want boolean")
    return df.select("*", E.valid_entity().alias("got")).collect()


def test_validation(verdicts):
    assert [r for r in verdicts if r.got != r.want] == []


def test_synonyms(spark):
    d = spark.createDataFrame([(1, "APT1", "apt_group", 90, "COMMENT PANDA|PLA Unit 61398|Comment Crew|Byzantine Candor")], "entity_id long, name string, category string, weight int, synonyms string")
    texts = ["seen COMMENT PANDA today", "pla unit 61398 again", "the Comment Crew", "Byzantine Candor, Comment Crew and comment panda", "PLA  Unit 61398", "apt1x", "APT1."]
    a = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "article_id long, title string, content string")
    got = {r.article_id: r.matched for r in E.match_dictionary(a, d).collect()}
    assert got == {0: "COMMENT PANDA", 1: "PLA Unit 61398", 2: "Comment Crew", 3: "COMMENT PANDA", 6: "APT1"}


def test_confidence(spark):
    a = spark.createDataFrame([(1, "CVE-2023-12345 Critical Vulnerability", "The vulnerability CVE-2023-12345 is critical. CVE-2023-12345 affects many systems.")], "article_id long, title string, content string")
    hits = spark.createDataFrame([(1, "CVE-2023-12345", "cve", 0.95)], "article_id long, name string, category string, confidence double")
    r = E.boost_confidence(hits, a).first()
    assert (r.confidence, r.position) == (1.0, "title")


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Microsoft patches critical vulnerability in Windows", True), ("Ransomware attack hits major hospital", True), ("Zero-day exploit discovered in Chrome", True), ("Cybersecurity firm reports data breach", True),
        ("Apple announces new iPhone features", False), ("Stock market reaches new highs", False), ("New restaurant opens downtown", False), ("Weather forecast for the weekend", False),
    ],
)
def test_relevance(spark, title, want):
    df = spark.createDataFrame([(title, "", "cybersecurity")], "title string, description string, feed_category string")
    assert O.security_relevant(O.scored(df)).first().relevant is want


def test_relevance_points(spark):
    df = spark.createDataFrame([("Microsoft patches critical vulnerability in Windows", ""), ("Zero-day exploit discovered in Chrome", None)], "title string, description string")
    assert [r.positive for r in O.scored(df).collect()] == [210, 115]


def test_title_patterns(spark):
    df = spark.createDataFrame([("Webinar: x",), ("A webinar",), (None,), ("[OT] y",)], "title string")
    assert [r.title for r in O.drop_title_patterns(df).collect()] == ["A webinar", None]


def test_published(spark):
    df = spark.createDataFrame([("Mon, 01 Jan 2024 10:00:00 GMT",), ("Mon, 1 Jan 2024 10:00:00 +0200",), ("2024-01-01T10:00:00.123Z",), ("soon",), (None,)], "pub_date string")
    got = [r.p for r in O.with_published(df, AS_OF).select(F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("p")).collect()]
    assert got == ["2024-01-01 10:00", "2024-01-01 08:00", "2024-01-01 10:00", "2024-01-02 00:00", "2024-01-02 00:00"]


PAGE = """<html><body><nav>Navigation menu</nav><article><h1>Main heading</h1><p>First paragraph of the story, long enough.</p><p>Second paragraph of the story.</p>
<p>Third paragraph &amp; the end of it all.</p><img src="https://a.example/images/test.jpg"></article><footer>Footer content</footer></body></html>"""


def test_page_text(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>unclosed")], "page_id long, html string")
    want = "Main heading\n\nFirst paragraph of the story, long enough.\n\nSecond paragraph of the story.\n\nThird paragraph & the end of it all."
    for rows in (T.extract_main_text(df), T.parse_main_text(df)):
        got = {r.page_id: r.main_text for r in rows.collect()}
        assert got[1] == want and got[2] == ""
    assert T.pick_image(df).where("page_id = 1").first().image == "https://a.example/images/test.jpg"


def test_cleaning(spark):
    text = "<b>News</b>  here\nHome About\nmalicious domain: bad-site.ru and https://x.y/z\n\nBy Some One\nRead more at once"
    got = T.clean_text(spark.createDataFrame([(text,), (None,)], "content string")).select(F.col("cleaned").alias("c")).collect()
    assert got[0].c == "News here\nmalicious bad-site.ru and\nat once" and got[1].c == ""


def test_ioc_lines(spark):
    lines = [
        ("f", 1, "ignored\tIntel::ADDR"), ("f", 2, "#fields\tindicator\tindicator_type"), ("f", 3, "45.83.64.1\tIntel::ADDR\tscan"), ("f", 4, "10.0.0.7\tIntel::ADDR\tlan"),
        ("f", 5, "evil.test-site.ru\tIntel::DOMAIN"), ("f", 6, "# comment"), ("f", 7, ""),
    ]
    df = spark.createDataFrame(lines, "feed string, line_no long, line string")
    parsed = I.read_tab_intel(df, "ip_address")
    assert sorted(r.ioc for r in parsed.collect()) == ["10.0.0.7", "45.83.64.1"]
    assert [r.ioc for r in I.validate_iocs(parsed).collect()] == ["45.83.64.1"]
    plain = spark.createDataFrame([("p", 1, '"bad.example-site.ru",2024'), ("p", 2, "// c"), ("p", 3, "# c"), ("p", 4, " ")], "feed string, line_no long, line string")
    assert [r.ioc for r in I.read_plain_intel(plain, "domain").collect()] == ["bad.example-site.ru"]


def test_ioc_tiers(spark):
    df = spark.createDataFrame([(n, f"{n}.com", "domain", f"f{k}") for n in range(1, 6) for k in range(n)], "n int, ioc string, ioc_type string, feed string")
    got = {r.ioc: r.weight for r in I.ioc_importance(I.corroborate(df)).collect()}
    assert got == {"1.com": 50, "2.com": 50, "3.com": 65, "4.com": 75, "5.com": 75}


def test_galaxy(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"values": [{"value": "TEST-APT-GROUP", "meta": {"synonyms": ["TEST-APT", "TestGroup"]}}, {"value": null}]}')
    r = K.read_galaxy(spark, str(tmp_path / "g.json"), "apt_group").collect()
    assert [(x.name, x.category, x.weight, x.source, x.synonyms) for x in r] == [("TEST-APT-GROUP", "apt_group", 50, "misp", ["TEST-APT", "TestGroup"])]


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x</link></item><item><title>B</title></item></channel></rss>")
    assert [(r.title, r.link) for r in O.read_feed_entries(spark, str(tmp_path / "f.xml")).collect()] == [("A", "http://x")]


@pytest.mark.parametrize("rule", ["keep", "overwrite", "greatest", "replace", "insert"])
def test_upsert_is_idempotent(spark, rule):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int")
    b = spark.createDataFrame([(2, 7), (3, 0), (4, 2)], "k int, v int")
    once = upsert(a, b, ["k"], rule)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, upsert(once, b, ["k"], rule).collect()), key=str)
    assert {r.k: r.v for r in once.collect()} == {"keep": {1: 5, 2: None, 3: 1, 4: 2}, "insert": {1: 5, 2: None, 3: 1, 4: 2}, "overwrite": {1: 5, 2: 7, 3: 0, 4: 2}, "replace": {1: 5, 2: 7, 3: 0, 4: 2}, "greatest": {1: 5, 2: 7, 3: 1, 4: 2}}[rule]


def _angles(spark):
    import math

    rows = [(i + 1, [math.cos(math.radians(x)), math.sin(math.radians(x))]) for i, x in enumerate([0, 10, 90, 100, 200])]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_clusters(spark):
    vec = _angles(spark)
    edges = V.similarity_join(vec, 0.75)
    labels = V.dbscan(edges, 2)
    assert {r.id: r.label for r in labels.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.label: round(r.coherence, 4) for r in V.coherence(labels, vec).collect()} == {1: 0.9848, 3: 0.9848}
    linked, large = V.average_linkage(edges, vec, 0.75)
    assert {r.id: r.label for r in linked.collect()} == {1: 1, 2: 1, 3: 3, 4: 3} and large.count() == 0


def test_linkage_of_large_components(spark):
    """A component above max_size is solved in rounds with the same clusters, equal vectors and clusters above a block among them."""
    import random

    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    points = [[x + rng.gauss(0, 0.4) for x in rng.choice(centers)] for _ in range(40)]
    vec = spark.createDataFrame(list(enumerate([*points, *[points[7]] * 12], 1)), "id long, vec array<double>")
    edges = V.similarity_join(vec, 0.7).cache()
    want = {r.id: r.label for r in V.average_linkage(edges, vec, 0.7)[0].collect()}
    got, large = V.average_linkage(edges, vec, 0.7, max_size=20)
    assert large.first().n > 20 and len(set(want.values())) > 3
    assert {r.id: r.label for r in got.collect()} == want
    rows = vec.join(edges.select(F.explode(F.array("i", "j")).alias("id")).distinct(), "id", "left_semi").select(F.lit(1).cast("long").alias("g"), "id", "vec")
    assert {r.id: r.label for r in V._linkage_rounds(rows, 0.7, 0, 16).collect()} == want


def test_trending_windows_slide_by_the_hour(spark, tmp_path):
    """A burst of 24 hours that starts between two strides of 12 hours is whole in one window."""
    from threatloom.streaming import stories as J

    start = dt.datetime(2024, 1, 2, 5, 30, tzinfo=dt.timezone.utc)
    rows = [("x", i, start + dt.timedelta(hours=i)) for i in range(24)] + [("y", 99, start + dt.timedelta(days=9))]
    spark.createDataFrame(rows, "name string, article_id long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema("name string, article_id long, at timestamp").parquet(str(tmp_path / "hits"))
    got = {r.s: r.mentions for r in J.drain(J.stream_trending(stream)).where("name = 'x'").select(F.date_format("w.start", "dd HH").alias("s"), "mentions").collect()}
    assert len(got) == 47 and got["02 05"] == 24 and got["02 04"] == got["02 06"] == 23


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_duplicate_clusters(spark):
    cols = "cluster_id long, article_ids array<long>, titles array<string>, feeds array<string>, entities array<string>"
    ents = ["ransomware_group:LockBit", "company:Healthcare"]
    new = spark.createDataFrame([(10, [3, 2], ["LockBit hits hospital"], ["1", "2"], ents), (11, [10], ["APT28 phishing"], ["3"], ["apt_group:APT28"])], cols)
    old = spark.createDataFrame([(1, [1, 2], ["LockBit hits hospital"], ["1", "2"], ents)], cols)
    got = {r.new_id: r.duplicate for r in V.duplicate_pairs(new, old).collect()}
    assert got == {10: True}
    assert {r.cluster_id: r.target for r in V.merge_clusters(new, V.duplicate_pairs(new, old)).collect()} == {10: 1, 11: 11}


def test_summary_entities(spark):
    doc = '{"net": {"domains": ["a.b", " c.d "], "cves": ["CVE-1", "CVE-2"]}, "who": {"apt_groups": ["x", "y"], "malware_families": ["m", "n"]}, "biz": {"companies": ["p", "q"], "security_vendors": ["v", "w"]}}'
    rows = H.summary_entities(spark.createDataFrame([(1, doc), (2, None), (3, "{")], "cluster_id long, entities string")).collect()
    assert len(rows) == 12 and {r.category for r in rows} == {"domain", "cve", "apt_group", "malware_family", "company", "security_vendor"}


def test_description(spark):
    got = spark.createDataFrame([("A (Citation: B) thing) with [link](http://x)..  end (ok).",), (None,)], "d string").select(H.clean_description(F.col("d")).alias("d")).collect()
    assert [r.d for r in got] == ["A thing with link. end (ok).", ""]


def test_follow_deltas(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    h = lambda n: t0 + dt.timedelta(hours=n)
    f = spark.createDataFrame([(1, 1, True, h(0), h(2)), (2, 1, True, h(0), None), (3, 1, False, h(0), None)], "user_id long, cluster_id long, notify boolean, created_at timestamp, last_notified_at timestamp")
    m = spark.createDataFrame([(1, 10, h(-1)), (1, 11, h(1)), (1, 12, h(3))], "cluster_id long, article_id long, added_at timestamp")
    assert sorted((r.user_id, r.article_id) for r in W.cluster_deltas(f, m, AS_OF).collect()) == [(1, 12), (2, 11), (2, 12)]


def test_jaccard(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [1]), ([1], [1])], "a array<int>, b array<int>")
    got = [(r.x, r.y) for r in df.select(V.jaccard("a", "b").alias("x"), V.jaccard("b", "a").alias("y")).collect()]
    assert got == [(1 / 3, 1 / 3), (0.0, 0.0), (1.0, 1.0)]


def test_rule_tables():
    assert len(R.UNLESS) == 22 and sum(len(t) for *_, t in R.POSITIVE) == 42


def test_stix(spark):
    clusters = spark.createDataFrame([(1, "story")], "cluster_id long, name string").withColumn("created_at", F.lit(AS_OF).cast("timestamp"))
    members = spark.createDataFrame([(1, 10), (1, 11)], "cluster_id long, article_id long")
    hits = spark.createDataFrame([(10, "A", "apt_group"), (11, "M", "malware_family"), (11, "T1059", "mitre_attack"), (10, "x", "company")], "article_id long, name string, category string")
    rows = H.export_stix(clusters, members, hits).collect()
    kinds = [r.obj_type for r in rows]
    assert sorted(kinds) == ["attack-pattern", "malware", "relationship", "relationship", "report", "threat-actor"]
    assert all(r.obj_id.startswith(r.obj_type + "--") for r in rows) and sorted(rows) == sorted(H.export_stix(clusters, members, hits).collect())


def test_nearest(spark):
    vec = _angles(spark)
    reps = vec.where("id IN (1, 3)").withColumnRenamed("id", "cluster_id")
    assert {r.id: r.cluster_id for r in V.assign_nearest(vec, reps, 0.75).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "tool.json").write_text('[{"name": "a", "weight": 5, "source": "s"}, {"name": "a", "weight": 7, "source": "t"}, {"name": "b"}]')
    assert [tuple(r) for r in K.load_dictionary(spark, str(tmp_path)).collect()] == [("a", "tool", 7, "t")]


def test_bundle_file(spark, tmp_path):
    obj = '{"type": "attack-pattern", "name": "%s", "revoked": %s, "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}, {"source_name": "x", "url": "u"}]}'
    (tmp_path / "b.json").write_text('{"objects": [%s, %s, %s, {"type": "tool"}]}' % (obj % ("one", "false"), obj % ("two", "false"), obj % ("gone", "true")))
    r = K.read_attack_bundle(spark, str(tmp_path / "b.json")).collect()
    assert [(x.technique_id, x.name, x.other_refs) for x in r] == [("T1", "two", ["u"])]


def test_intel_files(spark, tmp_path):
    (tmp_path / "x.intel").write_text("1.1.1.2\tIntel::ADDR\n#fields\tindicator\tindicator_type\n45.83.64.1\tIntel::ADDR\n")
    assert [r.ioc for r in I.read_tab_intel(I.read_lines(spark, str(tmp_path)), "ip_address").collect()] == ["45.83.64.1"]


def test_purge(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "cluster_id long, article_id long")
    clusters = spark.createDataFrame([(1, True), (2, True)], "cluster_id long, is_active boolean")
    kept, left, counts = H.purge({"members": members}, clusters, spark.createDataFrame([(12,), (10,)], "article_id long"))
    assert kept["members"].count() == 1 and {r.cluster_id: r.is_active for r in left.collect()} == {1: True, 2: False}
    assert [(r.name, r.removed) for r in counts.collect()] == [("members", 2)]


def test_stix_bodies(spark):
    import json

    clusters = spark.sql("SELECT 1L AS cluster_id, 'c' AS name, timestamp '2024-01-02 03:04:05' AS created_at UNION ALL SELECT 2L, 'empty', timestamp '2024-01-02 00:00:00'")
    names = [("10.1.1.1", "ip_address"), ("2001:db8::1", "ip_address"), ("a.net", "domain"), ("a" * 32, "file_hash"), ("b" * 40, "file_hash"), ("c" * 64, "file_hash"), ("T1059.001", "mitre_attack"), ("APT9", "apt_group"), ("Wiper", "malware_family"), ("Acme", "company")]
    members = spark.createDataFrame([(1, 7)], "cluster_id long, article_id long")
    hits = spark.createDataFrame([(7, n, c) for n, c in names], "article_id long, name string, category string")
    told = spark.createDataFrame([(1, "what happened", ["first", "second"])], "cluster_id long, summary string, insights array<string>")
    rows = H.export_stix(clusters, members, hits, told).collect()
    bodies = {r.obj_id: json.loads(r.body) for r in rows}
    reports = {r.cluster_id: bodies[r.obj_id] for r in rows if r.obj_type == "report"}
    assert reports[1]["description"] == "what happened\n\nKey Insights:\n• first\n• second\n" and reports[1]["published"] == "2024-01-02T03:04:05Z"
    assert reports[1]["object_refs"] == sorted(r.obj_id for r in rows if r.obj_type != "report") and len(reports[1]["object_refs"]) == 11
    assert reports[2] == {"name": "empty", "description": "", "published": "2024-01-02T00:00:00Z", "confidence": 80, "lang": "en", "object_refs": []}
    patterns = {b["pattern"] for b in bodies.values() if "pattern" in b}
    assert patterns == {"[ipv4-addr:value = '10.1.1.1']", "[ipv6-addr:value = '2001:db8::1']", "[domain-name:value = 'a.net']", f"[file:hashes.MD5 = '{'a' * 32}']", f"[file:hashes.SHA1 = '{'b' * 40}']", f"[file:hashes.SHA256 = '{'c' * 64}']"}
    assert {"name": "T1059.001", "external_references": [{"source_name": "mitre-attack", "external_id": "T1059.001", "url": "https://attack.mitre.org/techniques/T1059/001/"}]} in bodies.values()


def test_summary_fields(spark):
    import json

    good = {"summary": "s", "key_insights": list("abcdefgh"), "ttps": list("abcdefghij"), "sources": {"1": "x"}}
    bad = [{k: v for k, v in good.items() if k != gone} for gone in good] + [good | {"sources": ["x"]}, good | {"ttps": "x"}, good | {"key_insights": {}}, good | {"summary": 7}]
    df = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("{",), (None,)], "summary string")
    rows = H.check_summaries(df).collect()
    assert [r.valid for r in rows] == [True] + [False] * (len(bad) + 2)
    assert (rows[0].summary_text, rows[0].n_insights, rows[0].n_ttps) == ("s", 6, 8)


def test_public_suffixes(spark):
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",)], "suffix string")
    names = ["evil.com", "a.com", "bad-site.co.uk", "x.co.uk", "co.uk", "12345.com", "no.suffix", "deep.sub.name.com", "google.com", "MiXed.CO.UK", None]
    hits = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int")
    for most in (100, 0):
        assert sorted(r.name for r in E.valid_domains(hits, suffixes, most).collect()) == ["MiXed.CO.UK", "bad-site.co.uk", "deep.sub.name.com", "evil.com"]


def test_itemprop_selector(spark):
    text = "x" * 120
    page = f'<div itemprop="articleBody"><p>{text}</p></div><div class="post"><p>{"y" * 200}</p></div><div id="content"><p>short</p></div>'
    assert T.parse_main_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first().main_text == text


def test_rare_overlap(spark):
    """Pairs at an overlap of .3 meet in a rare entity: as many as of all pairs, whatever all have in common."""
    import random

    rng = random.Random(4)
    rows = [(i, [i], [f"t{i}"], ["f"], sorted({"company:common", *(f"tool:{rng.randrange(30)}" for _ in range(rng.randrange(7)))})) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster_id long, article_ids array<long>, titles array<string>, feeds array<string>, entities array<string>")
    new, old = df.where("cluster_id < 25"), df.where("cluster_id >= 25")
    pairs = lambda x: {(r.new_id, r.old_id) for r in x.where("ent >= 0.3").collect()}
    want = {(a[0], b[0]) for a in rows[:25] for b in rows[25:] if 10 * len(set(a[4]) & set(b[4])) >= 3 * len(set(a[4]) | set(b[4]))}
    assert pairs(V.overlaps(new, old, 0.3)) == pairs(V.overlaps(new, old)) == want and want


def test_nearest_blocks(spark):
    import random

    rng = random.Random(5)
    vec = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    reps = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(37)] + [(99, None)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {i: max((cos(v, r), -c) for c, r in reps if r) for i, v in vec}
    a, b = spark.createDataFrame(vec, "id long, vec array<double>"), spark.createDataFrame(reps, "cluster_id long, vec array<double>")
    for size in (2048, 10):
        got = {r.id: r.cluster_id for r in V.assign_nearest(a, b, 0.5, size).collect()}
        assert got == {i: -w[1] for i, w in want.items() if w[0] >= 0.5}


def test_stream_cluster_batches(spark, tmp_path):
    """A vector of a later batch joins the cluster of an earlier one; what is left makes new clusters."""
    batches = [[(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], [(4, [1.0, 0.02]), (5, [0.0, 0.9]), (6, [0.01, 1.0]), (7, [-1.0, 0.0])], [(8, [0.02, 1.0])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1).write.parquet(str(tmp_path / "v" / f"p={k}"))
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "v"))
    got = {r.id: r.label for r in J.stream_cluster(stream, 0.95).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 5, 6: 5, 8: 5}


def _linkage(vec, threshold):
    """Average linkage in plain Python: the closest two clusters merge while their mean distance is below 1 - threshold."""
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    groups = [[i] for i in vec]
    while len(groups) > 1:
        gap = lambda a, b: sum(1 - min(1.0, max(0.0, cos(vec[x], vec[y]))) for x in a for y in b) / (len(a) * len(b))
        d, i, j = min((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        if d >= 1 - threshold:
            break
        groups[j] += groups.pop(i)
    return {i: min(g) for g in groups for i in g}


def test_clustering_runs(spark):
    """F8, F9 and F26 against plain versions: a chain that density clustering makes one cluster of, linkage several."""
    import math
    import random

    rng = random.Random(31)
    angles = {i: 0.09 * i + rng.random() * 0.01 for i in range(17)} | {i: 2.5 + 0.3 * (i - 30) + rng.random() * 0.02 for i in range(30, 34)}
    vec = {i: [math.cos(a), math.sin(a)] for i, a in angles.items()}
    df = spark.createDataFrame(list(vec.items()), "id long, vec array<double>")
    threshold = 0.99
    want = _linkage(vec, threshold)
    sizes = {l: sum(x == l for x in want.values()) for l in want.values()}
    got = {r.id: r.label for r in V.average_linkage(V.similarity_join(df, threshold), df, threshold)[0].collect()}
    assert {i: l for i, l in got.items()} == {i: l for i, l in want.items() if i < 17}
    assert len({r.label for r in V.dbscan(V.similarity_join(df, threshold)).collect()}) == 1
    nine = {r.id: r.label for r in V.cluster_articles(df, threshold).collect()}
    assert nine == {i: l for i, l in want.items() if sizes[l] > 1}
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    dates = spark.createDataFrame([(i, start + dt.timedelta(minutes=i)) for i in vec], "id long, published_at timestamp")
    rows = {r.id: (r.label, r.similarity) for r in V.run_clustering(df, dates, AS_OF, 48, threshold).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    plain = {}
    for label in set(nine.values()):
        ids = [i for i, l in nine.items() if l == label]
        pairs = [cos(vec[a], vec[b]) for a in ids for b in ids if a < b]
        if sum(pairs) / len(pairs) >= threshold:
            center = [sum(vec[i][k] for i in ids) / len(ids) for k in range(2)]
            plain |= {i: (label, cos(vec[i], center)) for i in ids}
    assert rows.keys() == plain.keys() and plain
    assert all(rows[i][0] == l and abs(rows[i][1] - s) < 1e-5 for i, (l, s) in plain.items())


def test_character_references(spark):
    """Names, numbers, missing semicolons, numbers that are no characters, and stray ampersands, as the standard library decodes them."""
    texts = [
        "", "plain", "a &amp; b", "&amp;lt;", "&lt;b&gt;", "&notit; &notin; &not", "&hellip;&mdash;&rsquo;", "&#8217;&#x2019;&#X2019;", "&#0;&#13;&#128;&#150;&#x81;&#1;&#127;",
        "&#xD800;&#x110000;&#99999999999999999999;&#xFFFFFFFFFFFF;", "&#xFDD0;&#xFFFE;&#x1FFFF;", "&#x1F600;&#128512 x", "&&amp;&", "&nbsp;|&#160;|&eacute|&eacutex|&EACUTE;", "&#;&#x;&#xg;",
        "&bogus; &copy2020 &AMP &ngE;", "&#0065;&#x0041;&#xfeff;z", "a&b=c&lt=d", "&\n&quot;", "&" + "a" * 50 + ";", "&uuml; &euro;" * 5_000,
    ]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(texts)} | {len(texts): None}


def test_every_named_reference(spark):
    names = sorted(T.html5)
    df = spark.createDataFrame([(i, f"x&{n}y") for i, n in enumerate(names)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: html.unescape(f"x&{n}y") for i, n in enumerate(names)}
