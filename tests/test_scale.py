"""Joins whose work is bounded: same results as plain versions, and less looked at."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.operators import entities as E
from threatloom.operators import follows as W
from threatloom.operators import reports as H
from threatloom.operators import similarity as S
from threatloom.operators import vectors as V

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def hours(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors in tight groups, one of them a third of all, with equal, zero and null vectors."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 8))
    rows = [(k, (centers[0 if k % 3 == 0 else rng.integers(40)] + rng.normal(size=8) * 0.05).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[3][1]) for k in range(20)] + [(3000, [0.0] * 8), (3001, [0.0] * 8), (3002, None)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)


def cosines(rows):
    ids = np.array([i for i, v in rows if v is not None])
    x = S.unit(np.array([v for _, v in rows if v is not None]))
    return ids, np.clip(x @ x.T, 0, 1)


@pytest.mark.parametrize("threshold", [0.98, 0.7, 0.0])
def test_pivot_join(clustered, threshold):
    rows, df = clustered
    if threshold == 0:  # all pairs of a few
        rows, df = rows[:40] + rows[-3:], df.where("id < 40 OR id >= 3000")
    ids, sim = cosines(rows)
    p, q = np.nonzero(np.triu(sim >= threshold, 1))
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(p, q, strict=True)}
    report = {}
    got = S.similarity_join(df, threshold, pivots=32, size=32, report=report).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    assert report["vectors"] == len(ids)
    if threshold == 0.98:  # a third of all vectors are in one group, and are compared; others meet their own groups
        assert report["compared"] < 0.25 * len(ids) ** 2 / 2


def test_pivot_nearest(spark, clustered):
    rows, df = clustered
    reps = [(i, v) for i, v in rows if v is not None][:300:2] + [(5000, rows[0][1])]
    table = spark.createDataFrame(reps, "cluster_id long, vec array<double>")
    x, y = S.unit(np.array([v for _, v in rows if v is not None])), S.unit(np.array([v for _, v in reps]))
    sim = np.round(x @ y.T, 12)
    ids = [i for i, v in rows if v is not None]
    want = {i: max((s, -reps[k][0]) for k, s in enumerate(sim[n]) if s == sim[n].max()) for n, i in enumerate(ids)}
    for threshold in (0.9, -1.0):
        report = {}
        got = {r.id: (r.sim, -r.cluster_id) for r in S.assign_nearest(df, table, threshold, pivots=16, size=16, report=report).collect()}
        assert got == {i: w for i, w in want.items() if w[0] >= threshold}
    assert S.assign_nearest(df, table.limit(0), 0.5).count() == 0 and S.similarity_join(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("threshold", [0.35, 0.8])
def test_sparse_join(spark, threshold):
    """Sparse pairs as of all pairs, with far fewer candidates; a term that all have is in no list."""
    rng = random.Random(6)
    texts = []
    for k in range(300):
        base = random.Random(k // 4)
        texts.append(" ".join(["common"] + [f"t{int(base.paretovariate(0.7))}" for _ in range(25)] + [f"u{rng.randrange(400)}" for _ in range(6)]))
    df = spark.createDataFrame([(k, "", t) for k, t in enumerate(texts)], "article_id long, title string, content string")
    vectors = V.text_vectors(df).cache()
    full = {}
    for r in vectors.collect():
        full.setdefault(r.article_id, {})[r.term] = r.weight
    dot = lambda a, b: sum(w * b.get(t, 0.0) for t, w in a.items())
    want = {(i, j): dot(full[i], full[j]) for i in full for j in full if i < j}
    report = {}
    got = {(r.i, r.j): r.sim for r in S.sparse_similarity_join(vectors, threshold, block=16, report=report).collect()}
    assert got.keys() == {p for p, s in want.items() if s >= threshold} and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert report["most"] < 300 and report["candidates"] < len(want)


def test_coherence_in_closed_form(spark, clustered):
    """Tight labels are summed, loose ones compared; both as by pairs."""
    rows, df = clustered
    rng = np.random.default_rng(8)
    loose = [(9000 + k, rng.normal(size=8).tolist()) for k in range(30)]
    every = [(i, v) for i, v in rows if v is not None] + loose
    ids, sim = cosines(every)
    first = {i: (1 if i % 3 == 0 else 2) if i < 1500 and i % 3 == 0 else 3 if i >= 9000 else 4 if i >= 3000 else 5 if i == 1 else None for i in ids}
    labels = [(int(i), l) for i, l in first.items() if l]
    report = {}
    vec = spark.createDataFrame(every, "id long, vec array<double>")
    got = {r.label: (r.size, r.coherence) for r in V.coherence(spark.createDataFrame(labels, "id long, label long"), vec, report).collect()}
    place = {i: k for k, i in enumerate(ids)}
    for label in {l for _, l in labels}:
        at = [place[i] for i, l in labels if l == label]
        pairs = [sim[a, b] for n, a in enumerate(at) for b in at[:n]]
        assert got[label][0] == len(at) and abs(got[label][1] - (np.mean(pairs) if pairs else 1.0)) < 1e-9
    assert report["compared"] == 1  # the loose one


def test_centroids(spark):
    points = {1: [1.0, 0.0], 2: [0.8, 0.2], 3: [0.0, 1.0], 4: [5.0, 5.0]}
    vec = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "id long, label long")
    assert {r.label: r.id for r in V.primary_article(labels, vec).collect()} == {7: 2, 8: 4}
    center = [0.6, 0.4]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0, 0]) / math.dist(b, [0, 0])
    got = {r.id: r.similarity for r in V.member_similarity(labels, vec).collect()}
    assert all(abs(got[i] - cos(points[i], center if i < 4 else points[4])) < 1e-6 for i in points)


def test_entity_deltas_of_a_hot_entity(spark):
    """One entity in all articles: followers meet its newest k alone, and get what a full join gives."""
    rng = random.Random(2)
    articles = [(k, hours(rng.randrange(96))) for k in range(400)]
    hits = [(k, 1) for k, _ in articles] + [(k, rng.randrange(2, 9)) for k, _ in articles for _ in range(2)]
    follows = [(u, u * 10 + f, e, u % 5 > 0, hours(rng.randrange(90)) if u % 3 else None) for u in range(25) for f in range(2) for e in {1, rng.randrange(2, 9), rng.randrange(2, 9)}]
    as_of, k = "2024-01-04 12:00:00", 4
    a = spark.createDataFrame(articles, "article_id long, published_at timestamp")
    h = spark.createDataFrame(hits, "article_id long, entity_id long")
    f = spark.createDataFrame(follows, "user_id long, feed_id long, entity_id long, notify boolean, last_activity timestamp")
    end, want = dt.datetime(2024, 1, 4, 12, tzinfo=dt.timezone.utc), {}
    when, named = dict(articles), {}
    for i, e in hits:
        named.setdefault(i, set()).add(e)
    for key in {(u, g) for u, g, _, n, _ in follows if n}:
        mine = [(e, t) for u, g, e, n, t in follows if (u, g) == key and n]
        since = max((t for _, t in mine if t), default=end - dt.timedelta(hours=24))
        found = sorted((-when[i].timestamp(), i) for i in named if since < when[i] <= end and named[i] & {e for e, _ in mine})
        for n, (_, i) in enumerate(found[:k], 1):
            want[(*key, i)] = (n, sorted(named[i] & {e for e, _ in mine}))
    for source in (h, lambda ids: h.join(ids, "article_id", "left_semi")):
        got = {(r.user_id, r.feed_id, r.article_id): (r.rn, r.entity_ids) for r in W.entity_deltas(f, source, a, as_of, k).collect()}
        assert got == want and want
    assert W.newest_by_entity(h.distinct().join(a, "article_id"), k).groupBy("entity_id").count().agg(F.max("count")).first()[0] == k


def test_dictionary_of_many_phrases(spark):
    """Names of thousands of entities, of one and several tokens with signs between, against plain search; both ways of joining."""
    rng = random.Random(12)
    syllables = ["ka", "ro", "mi", "te", "lu", "sa", "no", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    names = [(i, rng.choice([word(), f"{word()} {word()}", f"{word()}-{word()}", f"{word()} {word()}.{word()}"])) for i in range(6000)]
    rows = [(i, n, "tool", 50, "|".join({word().upper(), f"{word()} {word()}"} - {n}) if i % 2 else "") for i, n in names]
    texts = [(k, word(), rng.choice([" ", "\n"]).join(rng.choice([word(), rng.choice(names)[1], f"({word()})"]) for _ in range(60))) for k in range(20)]
    import re

    want = set()
    for k, title, content in texts:
        low = f"{title}\n\n{content}".lower()
        run = " " + " ".join(re.findall(r"\w+", low)) + " "
        for i, n, _, _, syn in rows:
            for phrase in [n, *filter(None, syn.split("|"))]:
                p = phrase.lower()
                if p in low and f" {' '.join(re.findall(chr(92) + 'w+', p))} " in run:
                    want.add((k, i, phrase))
                    break
    a = spark.createDataFrame(texts, "article_id long, title string, content string")
    d = spark.createDataFrame(rows, "entity_id long, name string, category string, weight int, synonyms string")
    for most in (100_000, 10):
        got = E.match_dictionary(a, d, most).select("article_id", "entity_id", "matched").collect()
        firsts = {(k, i): m for k, i, m in want}
        assert {(r.article_id, r.entity_id): r.matched for r in got} == firsts and len(got) == len(firsts) > 300


def test_reports_left_out_before(spark):
    """The window, the internal feed, sources of summaries and their weights, counts and reports."""
    d = spark.createDataFrame([(1, "a", "company", "ai_extracted", ""), (2, "b", "cve", "ai_extracted", ""), (3, "c", "company", "misp", ""), (4, "d", "tool", "ai_extracted", "x"), (5, "e", "tool", "ai_extracted", None)], "entity_id long, name string, category string, source string, description string")
    assert [r.entity_id for r in H.needs_description(d).collect()] == [5, 1]
    flat = spark.createDataFrame([(1, "apt_group", "New"), (1, "apt_group", "NEW"), (1, "other", "thing"), (2, "company", "A")], "cluster_id long, category string, name string")
    got = {(r.name, r.category): (r.weight, r.source) for r in H.sync_entities(flat, d.select("name", "category")).collect()}
    assert got == {("NEW", "apt_group"): (85, "ai_extracted"), ("thing", "other"): (50, "ai_extracted")}
    c = spark.createDataFrame([(1, True, "x", hours(1)), (2, True, None, hours(1)), (3, True, "x", hours(-99))], "cluster_id long, has_summary boolean, entities string, summary_at timestamp")
    assert [r.cluster_id for r in H.recent_summaries(c, "2024-01-01 05:00:00", 24).collect()] == [1]
    articles = spark.createDataFrame([(1, "t", "c", 1, hours(0)), (2, "t", "c", 2, hours(0)), (3, "t", "c", 1, hours(-99))], "article_id long, title string, content string, feed_id long, published_at timestamp")
    rankings = spark.createDataFrame([(k, 70, 1.0, 2.0, 3.0, 4.0) for k in (1, 2, 3)], "article_id long, score int, recency_score double, source_credibility double, entity_importance double, keyword_severity double")
    feeds = spark.createDataFrame([(1, "news"), (2, "own briefs")], "feed_id long, name string")
    hits = spark.createDataFrame([(1, "x", 60)], "article_id long, name string, weight int")
    rows = H.top_unclustered(articles, rankings, spark.createDataFrame([], "article_id long"), hits, feeds, "2024-01-01 05:00:00", 24, 5, "own briefs").collect()
    assert [(r.article_id, r.source, r.entities, r.keyword_severity) for r in rows] == [(1, "news", "x", 4.0)]
    merged = V.merge_clusters(spark.createDataFrame([(1,), (2,), (3,)], "cluster_id long"), spark.createDataFrame([(1, 9, True), (2, 8, False)], "new_id long, old_id long, duplicate boolean"))
    assert tuple(V.merge_counts(merged).first()) == (2, 1, 1)


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    from threatloom.sources.upsert import upsert, upsert_buckets, write_buckets

    target = spark.createDataFrame([(k, "a", k) for k in range(500)], "k long, s string, v long")
    updates = spark.createDataFrame([(3, "b", 1000), (700, "b", 7), (44, "b", -5)], "k long, s string, v long")
    for rule in ("keep", "insert", "overwrite", "greatest", "replace"):
        path = tmp_path / rule
        write_buckets(target, str(path), ["k"], 32)
        before = {f: f.stat().st_mtime_ns for f in path.glob("__bucket=*/*.parquet")}
        assert upsert_buckets(str(path), updates, ["k"], rule, buckets=32) <= 3
        after = {f: f.stat().st_mtime_ns for f in path.glob("__bucket=*/*.parquet")}
        assert len({f.parent for f in before.items() ^ after.items() for f in [f[0]]}) <= 3 and len(before.keys() & after.keys()) >= len(before) - 3
        got = spark.read.parquet(str(path)).select("k", "s", "v").collect()
        assert sorted(got) == sorted(upsert(target, updates, ["k"], rule).collect())


def _stream(spark, tmp_path, name, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_ingest_knows_history(spark, tmp_path):
    from threatloom.streaming import stories as J

    item = lambda link, h=0: ("Ransomware attack exploits critical vulnerability", "", link, hours(h), "cybersecurity")
    schema = "title string, description string, link string, published_at timestamp, feed_category string"
    stored = spark.createDataFrame([("old",)], "link string")
    stream = _stream(spark, tmp_path, "items", [[item("a"), item("old"), item("a", 1)], [item("b"), item("a", 2)]], schema)
    run = lambda: sorted(r.link for r in J.ingest_batches(stream, ["x.com"], stored, str(tmp_path / "base")).collect())
    assert run() == ["a", "b"] and run() == ["a", "b"]
    spark.createDataFrame([item("b", 400), item("c", 400)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "items"))
    assert run() == ["a", "b", "c"]  # b is past the watermark's memory, and is found in what was written


def test_late_items_reach_both_sinks_once(spark, tmp_path):
    from threatloom.streaming import stories as J

    stream = _stream(spark, tmp_path, "late", [[(hours(0),), (hours(-999),), (hours(1),)], [(hours(2),), (hours(-998),)]], "published_at timestamp")
    failed = []

    def fails_once(df, path):
        if not failed:
            failed.append(path)
            df.write.mode("overwrite").parquet(path)
            raise OSError("the second sink failed")
        df.write.mode("overwrite").parquet(path)

    with pytest.raises(Exception, match="second sink"):
        J.route_late(stream, "2024-01-01 05:00:00", 24, str(tmp_path / "r"), {"late": fails_once})
    got = J.route_late(stream, "2024-01-01 05:00:00", 24, str(tmp_path / "r"), {"late": fails_once}).groupBy("sink").agg(F.sum("n").alias("n")).collect()
    assert {r.sink: r.n for r in got} == {"kept": 3, "late": 2} and failed


def test_stream_cluster_restarts(spark, tmp_path):
    """A stream that stops after two batches goes on with their clusters."""
    from threatloom.streaming import stories as J

    schema, base = "id long, vec array<double>", str(tmp_path / "base")
    stream = _stream(spark, tmp_path, "v", [[(1, [1.0, 0.0]), (2, [1.0, 0.01])], [(3, [0.0, 1.0]), (4, [0.01, 1.0])]], schema)
    assert {r.id: r.label for r in J.stream_cluster(stream, 0.95, base=base).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    spark.createDataFrame([(5, [1.0, 0.02]), (6, [0.02, 1.0]), (7, [-1.0, 0.0])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    again = spark.readStream.schema(schema).parquet(str(tmp_path / "v"))
    assert {r.id: r.label for r in J.stream_cluster(again, 0.95, base=base).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 3}


def test_trending_sketches(spark, tmp_path):
    """Distinct articles of merged panes are within 5 % of the exact counts."""
    from threatloom.streaming import stories as J

    rng = random.Random(9)
    rows = [("x", rng.randrange(3000), hours(rng.randrange(72))) for _ in range(9000)] + [("y", 1, hours(999))]
    stream = _stream(spark, tmp_path, "hits", [rows], "name string, article_id long, at timestamp")
    got = J.drain(J.stream_trending(stream)).where("name = 'x'").select(F.unix_seconds("w.start").alias("s"), "mentions", "articles").collect()
    assert len(got) == 95
    for r in got:
        inside = [i for n, i, t in rows if n == "x" and r.s <= t.timestamp() < r.s + 86400]
        assert r.mentions == len(inside) and abs(r.articles - len(set(inside))) <= 0.05 * len(set(inside)) + 1
