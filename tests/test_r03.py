"""Faults that larger tables and odd inputs brought to light."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from threatloom.llm import common, lm_score
from threatloom.operators import graph as G
from threatloom.operators import products as P
from threatloom.operators import similarity as S
from threatloom.operators import vectors as V
from threatloom.plans import q_entities, q_feeds, q_reports, q_vectors  # noqa: F401
from threatloom.plans.tables import with_views

SF = "/root/testdata/sf0.001"


def _with(tmp_path, **tables: pd.DataFrame) -> str:
    """The smallest tables with some replaced."""
    for name in os.listdir(SF):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{SF}/{name}", tmp_path / name)
    for name, rows in tables.items():
        rows.to_parquet(tmp_path / f"{name}.parquet", index=False)
    return str(tmp_path)


def test_cut_references(spark, tmp_path):
    """A page text that ends inside a reference: its SQL knows whole references alone."""
    body = "word " * 30
    texts = [f"<title>one &amp{x}</title><article><p>{body}&amp{x}</p><p>{body}&lt;b&gt; &amp;lt; &#39;&copy;{x}</p></article>" for x in ("", ";", " two")]
    pages = pd.DataFrame({"page_id": [*range(6)], "url": ["http://a.org/x", None] * 3, "html": texts + ["<title>a&amp</title><p>short&amp</p>", None, ""]})
    d = _with(tmp_path, pages=pages)
    duck = connect(d)
    for name in ("b11_main_text", "b12_choose_content", "b15_clean_title", "b17_clean_stats"):
        assert_same(q_feeds.queries()[name](spark, d).toPandas(), duck.sql(q_feeds.oracle_sql()[name]).df())


def test_every_cluster_has_a_profile(spark):
    got = {r.cluster_id for r in q_vectors.queries()["f14_cluster_profiles"](spark, SF).collect()}
    members = connect(SF).sql(with_views("SELECT DISTINCT cluster_id FROM members", "members")).fetchall()
    assert got == {c for (c,) in members}


@pytest.fixture(scope="module")
def loose(spark):
    """Vectors of single precision: chains, lone ones, equal ones, a zero, a null."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    rows = [(k * 3, x[k if k % 9 else k // 2].tolist()) for k in range(400)] + [(2000, [0.0] * 6), (2001, None)]
    return spark.createDataFrame(rows, "id long, vec array<float>").repartition(3).cache()


@pytest.mark.parametrize("least", [2, 4, 6])
def test_density_clusters_without_pairs(loose, least, monkeypatch):
    edges = S.similarity_join(loose, 0.9).cache()
    want = sorted(map(tuple, V.dbscan(edges, least).collect()))
    assert want and len({label for _, label in want}) > 1
    small = {f: (lambda f: lambda vec, t, *m: f(vec, t, *m, pivots=8, size=32))(getattr(S, f)) for f in ("linked", "some_neighbours")}
    for sizes in ({}, small):  # blocks of all vectors, and many
        for name, f in sizes.items():
            monkeypatch.setattr(V, name, f)
        assert sorted(map(tuple, V.dbscan_vectors(loose, 0.9, least).collect())) == want
    assert sorted(map(tuple, S.similarity_join(loose, 0.9, pivots=8, size=32).select("i", "j").collect())) == sorted(map(tuple, edges.select("i", "j").collect()))


def test_links_stay_few(loose):
    """A vector is one link at most in each block pair, and is sent as it is stored, once a room: not once a pair or pivot."""
    n, pairs = loose.count(), S.similarity_join(loose, 0.1).count()
    links = S.linked(loose, 0.1)
    assert pairs > 20 * n and links.count() < n
    dealt = S._met(loose, 0.1, 64, 100)
    assert dealt.schema["vec"].dataType.simpleString() == "array<float>" and dealt.count() < 8 * n


def test_thin_edges(spark):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (2000, 2))], "a long, b long")
    fewer = G.thin(edges, 400)
    assert fewer.count() <= 900
    assert sorted(map(tuple, G.components(fewer).collect())) == sorted(map(tuple, G.components(edges).collect()))


def test_target_is_all_good_documents(spark):
    """More good documents than the 20,000 that the target was once cut to."""
    ids = spark.range(30_000)
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    models = lm_score.train(ids.select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")), labels)
    assert sorted(models.words["target"].tolist()) == [0, 30_000, 30_000, 30_000]


def test_duplicates_without_hopeless_pairs(spark):
    """Titles are compared only where they can make a duplicate; all duplicates stay."""
    kind = "cluster_id long, article_ids array<long>, titles array<string>, feeds array<string>, entities array<string>"
    e = [f"apt_group:g{k}" for k in range(4)] + [f"tool:t{k}" for k in range(4)]
    rows = [(n, [n], [("one two three", "four five", "one two")[n % 3]], [f"f{n % 2}"], e[n % 4 : n % 4 + 1 + n % 5]) for n in range(40)]
    new, old = spark.createDataFrame(rows[:15], kind), spark.createDataFrame(rows[15:], kind)
    every, some = (V.duplicate_pairs(new, old, scored=x).collect() for x in (True, False))
    pairs = lambda rows: sorted((r.new_id, r.old_id, r.blend) for r in rows if r.duplicate)
    assert pairs(every) == pairs(some) != [] and len(some) < len(every)


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_pairs_of_profiles_only_as_results(spark, least, monkeypatch):
    """Profile pairs leave the task that compares their blocks as results: no pair is joined, shuffled or stored; all are right."""
    for name, n in (("PROFILE_BLOCK", 16), ("PROFILE_TILE", 5), ("OUT_ROWS", 7)):
        monkeypatch.setattr(V, name, n)
    kind = "cluster_id long, article_ids array<long>, titles array<string>, feeds array<string>, entities array<string>"
    rng = np.random.default_rng(8)
    some = lambda names, most: [names[k] for k in rng.permutation(len(names))[: rng.integers(0, most)]]
    names = [f"{c}:{x}" for c in ("apt_group", "company", "tool", "malware_family") for x in ("a", "A", "b", "c")]
    rows = [(n, some(list(range(40)), 4), [" ".join(some(list("uvwxyz"), 5)), "aa bb aa"][: n % 3], some(["f", "g", "h"], 4), some(names, 9)) for n in range(120)]
    new, old = spark.createDataFrame(rows[:50], kind), spark.createDataFrame(rows[50:], kind)
    share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    every = {(a[0], b[0]): (share(a[1], b[1]), share(a[4], b[4]), share(a[3], b[3]), a, b) for a in rows[:50] for b in rows[50:]}
    want = {k: v for k, v in every.items() if (v[1] >= least if least else v[0] or v[1])}
    found = V.duplicate_pairs(new, old) if least else V.overlaps(new, old)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1
    got = {(r.new_id, r.old_id): r for r in found.collect()}
    assert got.keys() == want.keys() and want
    weight = lambda e: V.KEY_WEIGHTS.get(e.split(":")[0], 0.0)
    low = lambda x: {e.lower() for e in x if weight(e)}
    for k, (art, ent, src, a, b) in want.items():
        assert (got[k].art, got[k].ent, got[k].src) == (art, ent, src)
        if least:
            both, union = (sum(map(weight, x)) for x in (low(a[4]) & low(b[4]), low(a[4]) | low(b[4])))
            assert abs(got[k].key - (both / union if union else 0.0)) < 1e-9
            words = [" ".join(x[2]).split() for x in (a, b)]
            words = [[w for w in x if len(w) > 1] for x in words]
            grams = [pd.Series([*x, *map(" ".join, zip(x, x[1:]))], dtype=object).value_counts() for x in words]
            idf = lambda g: 1.0 if g in grams[0] and g in grams[1] else 1 + np.log(1.5)
            x, y = ({g: n * idf(g) for g, n in c.items()} for c in grams)
            norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert abs(got[k].ttl - (sum(v * y.get(g, 0.0) for g, v in x.items()) / norm if norm else 0.0)) < 1e-9


def test_levels_of_spelling_are_small_plans(spark, monkeypatch):
    """A level of the trie is two joins, whose plans the driver keeps for each of up to 60 levels."""
    from threatloom.llm import spelling

    plans, write = {}, spelling.materialize

    def noted(df, name, *by):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *by)

    monkeypatch.setattr(spelling, "materialize", noted)
    rows = [(k, w) for k, w in enumerate(["lantern lantern", "lanterns lanterns", "lamtern lamtern", "xlantern xlantern"])]
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), damage=None).collect()
    assert {r.word: r.n_near for r in got} == {"lantern": 3, "lanterns": 1, "lamtern": 1, "xlantern": 1}
    levels = [p for n, p in plans.items() if n.removeprefix("trie-").isdigit()]
    assert len(levels) >= 8 and all(p.count("Join") <= 2 for p in levels)


def test_text_vectors_join_once(spark):
    """Rows of a vector meet their idf in one join and are moved once more, for the norm; a null id has no vector."""
    rows = [(1, "a title", "one two two"), (2, None, "two"), (None, "x", "one"), (3, None, None)]
    found = V.text_vectors(spark.createDataFrame(rows, "article_id long, title string, content string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = found.groupBy("article_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("q"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.article_id, r.n) for r in got) == [(1, 3), (2, 1)] and all(abs(r.q - 1) < 1e-12 for r in got)


def test_sparse_join_stores_no_pairs(spark, monkeypatch):
    """A hundred vectors share their first term, and all 4,950 pairs reach the threshold: no written table has more rows than the
    vectors have terms; null ids are left out, and ids can be strings."""
    sizes, write = {}, S.materialize

    def noted(df, name, *by):
        out = write(df, name, *by)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(S, "materialize", noted)
    rows = [(f"d{k:03}", t, w) for k in range(100) for t, w in (("all", 0.8), (f"own{k}", 0.6))]
    vectors = spark.createDataFrame([*rows, (None, "all", 1.0)], "article_id string, term string, weight double")
    got = {(r.i, r.j): r.sim for r in S.sparse_similarity_join(vectors, 0.5, block=32).collect()}
    assert got.keys() == {(f"d{i:03}", f"d{j:03}") for i in range(100) for j in range(i + 1, 100)}
    assert all(abs(v - 0.64) < 1e-12 for v in got.values()) and max(sizes.values()) <= len(rows)
    assert S.sparse_similarity_join(vectors.limit(0), 0.5).count() == 0


def test_some_products():
    """Products of chosen rows as those of all; a block in order of codes gives the same."""
    rng = np.random.default_rng(3)
    x, y = (np.where(rng.random((n, 40)) < 0.3, rng.random((n, 40)), 0) for n in (30, 50))
    x[:, 0] = y[:, 0] = 1.0
    a, b = (P.Entries(len(m), *np.nonzero(m), m[np.nonzero(m)]) for m in (x, y))
    p, q = np.nonzero(rng.random((30, 50)) < 0.1)
    assert np.allclose(P.some_products(a, b, p, q), (x @ y.T)[p, q]) and not len(P.some_products(a, b, p[:0], q[:0]))
    for rare in (1, 64):
        assert np.allclose(P.products(a, b.where(np.argsort(b.code, kind="stable")), rare), x @ y.T)


def test_sketch_moves_no_rows_to_python(spark):
    """A sketch gets a number of each row, not its columns; groups that are all small are joined once."""
    rows = spark.range(3000).select("id", (F.col("id") % 1500).alias("k"), F.lit("a long text").alias("t"))
    kept = common.likely(rows, rows.where("k < 5").select("k"), "k")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan and kept.columns == rows.columns
    assert kept.where("k < 5").count() == 10 and kept.count() < 20
    assert common.likely(rows, rows.where("k < 0").select("k"), "k").count() == 0
    small = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how, found, joins in (("inner", small, 1), ("left", small.where("k < 5"), 3), ("inner", small.where("k < 0"), 1)):
        got = common.join_groups(rows, found, ["k"], how)
        assert got._jdf.queryExecution().analyzed().toString().count("Join ") == joins
        assert got.count() == (0 if how == "inner" and joins == 1 and found.isEmpty() else 3000)
