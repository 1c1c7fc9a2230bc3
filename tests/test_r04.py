"""What the findings of round 4 were about, on small tables."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from threatloom.operators import linkage as L
from threatloom.operators import similarity as S
from threatloom.operators import vectors as V


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_vectors_are_written_once(spark, monkeypatch):
    """However many blocks there are, the table they meet from has a row a vector, and their pairs are read from it without an exchange."""
    sizes, write = {}, S.pack

    def noted(rows, block, name):
        sizes[name] = rows.count()
        return write(rows, block, name)

    monkeypatch.setattr(S, "pack", noted)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((90, 20)) < 0.3, rng.random((90, 20)), 0.0)
    x[:, 0] += 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, f"t{k}", float(v)) for i, row in enumerate(x) for k, v in enumerate(row) if v], "article_id long, term string, weight double")
    found = S.sparse_similarity_join(vectors, 0.5, block=8)
    assert "Exchange" not in plan_of(found) and sizes == {"vectors": 90}
    sim = x @ x.T
    got = {(r.i, r.j): r.sim for r in found.collect()}
    assert got.keys() == {(i, j) for i in range(90) for j in range(i + 1, 90) if sim[i, j] >= 0.5} and len(got) == found.count()
    assert all(abs(v - sim[k]) < 1e-9 for k, v in got.items())


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_clusters_are_read_where_they_meet(spark, monkeypatch):
    """The nearest cluster of each changed one, with clusters wider than a block's quarter, and no exchange of vectors after they are
    written once."""
    sizes, write = {}, L.pack

    def noted(rows, block, name, *by):
        sizes[name] = rows.count()
        return write(rows, block, name, *by)

    monkeypatch.setattr(L, "pack", noted)
    for name, n in (("TILE", 7), ("LEAST", 20), ("AGAIN", 50)):
        monkeypatch.setattr(L, name, n)
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(120, 6)))
    c = np.sort(np.where(np.arange(120) < 30, 0, rng.integers(30, 75, 120)))
    names, first = np.unique(c, return_index=True)
    g = np.where(names < 60, 0, 1)  # two components
    dirty = [int(n) for n in names if n == 0 or n % 3]
    rows = [(int(g[k]), i, x[i].tolist(), int(n), int((c == n).sum())) for k, n in enumerate(names) for i in range(120) if c[i] == n]
    rows = spark.createDataFrame(rows, "g long, id long, vec array<double>, c long, n long")
    sums = np.add.reduceat(np.add.reduceat(np.clip(x @ x.T, 0, 1), first, axis=0), first, axis=1)
    n = np.diff(np.append(first, 120))
    mean = np.where(g[:, None] == g[None, :], sums / np.outer(n, n), -1)
    np.fill_diagonal(mean, -1)
    want = {d: (int(names[mean[k].argmax()]), mean[k].max()) for k, d in ((int(np.flatnonzero(names == d)[0]), d) for d in dirty) if mean[k].max() > 0.3}
    for size in (16, 512):
        found = L.nearest_clusters(rows, spark.createDataFrame([(d,) for d in dirty], "c long"), 0.3, size)
        got = {r.a: (r.b, r.sim) for r in found.collect()}
        assert sizes == {"members": 120} and len(want) > 20
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_tight_groups_join_at_once(spark, monkeypatch):
    """Near copies merge before all else: they start as one cluster, and take no round for each few of them."""
    rounds, write = [], V.materialize

    def noted(df, name, *by):
        rounds.append(name)
        return write(df, name, *by)

    monkeypatch.setattr(V, "materialize", noted)
    monkeypatch.setattr(L, "TILE", 7)
    rng = np.random.default_rng(9)
    base = unit(rng.normal(size=(12, 8)))
    x = unit(np.concatenate([np.repeat(base[:2], 40, axis=0) + 0.02 * rng.normal(size=(80, 8)), base[2:], base[1:2] + 0.35 * unit(rng.normal(size=(1, 8)))]))
    ids = (rng.permutation(len(x)) + 100).astype(np.int64)
    rows = spark.createDataFrame([(0, int(i), v.tolist()) for i, v in zip(ids, x)], "g long, id long, vec array<double>")
    sim = x @ x.T
    want = {}
    for k in range(L.LEVELS, 0, -1):
        for i in range(len(x)):
            near = np.flatnonzero(sim[i] > 1 - 0.5 / 2**k)
            if len(near) > 1 and all(set(np.flatnonzero(sim[j] > 1 - 0.5 / 2**k)) == set(near) for j in near):
                want[int(ids[i])] = int(ids[near].min())
    got = {r.id: r.c for r in L.tight_groups(rows, 0.5, 16).collect()}
    assert got == want and len(want) >= 80
    solved = V._solve_linkage(pd.DataFrame({"id": ids, "vec": list(x), "c": ids}), 0.5)
    rounds.clear()
    labels = {r.id: r.label for r in V._linkage_rounds(rows, 0.5, 0, 16).collect()}
    assert labels == dict(zip(solved.id, solved.label)) and rounds.count("near") <= 6


def test_articles_are_compared_once_for_both_methods(spark, monkeypatch):
    """F9 takes F7's clusters as the components of F8."""
    calls, compare = [], V.linked
    monkeypatch.setattr(V, "linked", lambda *a, **k: calls.append(1) or compare(*a, **k))
    rng = np.random.default_rng(1)
    x = np.repeat(unit(rng.normal(size=(2, 6))), 30, axis=0) + 0.3 * rng.normal(size=(60, 6))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    two = {r.id: r.label for r in V.average_linkage(V.similarity_join(vec, 0.8), vec, 0.8)[0].collect()}
    more = {i: n for i, n in two.items() if list(two.values()).count(n) > 1}
    one = {r.id: r.label for r in V.dbscan_vectors(vec, 0.8).collect()}
    calls.clear()
    got = {r.id: r.label for r in V.cluster_articles(vec, 0.8).collect()}
    assert got == (more if len({*more.values()}) > len({*one.values()}) and len({*one.values()}) < 6 else one) and len(calls) == 1
    assert len({*one.values()}) < 6 and got == more


def profiles(spark, n=160):
    rng = np.random.default_rng(8)
    some = lambda names, most: [names[k] for k in rng.permutation(len(names))[: rng.integers(0, most)]]
    names = sorted(f"{c}:{x}" for c in ("apt_group", "tool", "malware_family") for x in ("a", "b"))
    rows = [(n, some(list(range(60)), 4), [" ".join(some(["uu", "vv", "ww", "xx"], 5)), "aa bb aa"][: n % 3], some(["f", "g"], 3), sorted(some(names, 5))) for n in range(n)]
    kind = "cluster_id long, article_ids array<long>, titles array<string>, feeds array<string>, entities array<string>"
    return spark.createDataFrame(rows[: n // 3], kind), spark.createDataFrame(rows[n // 3 :], kind)


def test_only_duplicates_come_back_for_merging(spark):
    """Pairs that titles could have made duplicates, but don't, are left out where they are compared; all duplicates are kept."""
    new, old = profiles(spark, 500)
    every, some = (V.duplicate_pairs(new, old, scored=x).collect() for x in (True, False))
    found = lambda rows: {(r.new_id, r.old_id): (r.blend, round(r.ttl, 9), r.art) for r in rows if r.duplicate}
    assert found(every) == found(some) and len(found(some)) == len(some) > 50
    assert {0.0} < {v[2] for v in found(some).values()} and any(0.1 < v[1] < 0.9 for v in found(some).values())


def test_profiles_are_not_sent_for_each_block(spark):
    """Blocks of profiles are read where they meet."""
    new, old = profiles(spark, 30)
    assert "Exchange" not in plan_of(V.overlaps(new, old)) and "Exchange" not in plan_of(V.duplicate_pairs(new, old))


def test_rounded_as_round_does(spark):
    rng = np.random.default_rng(0)
    values = [*rng.random(2000).tolist(), *(rng.integers(0, 200, 500) / 128).tolist(), 0.0000005, 1.0000005, 0.9999995, 2.5e-7, -0.0078125, 1e5, 123456.7890125, 1e300, float("nan"), float("inf"), None, *((k + 0.5) / 1e6 for k in range(500))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(V.rounded("x").alias("a"), F.round("x", 6).alias("b"))
    assert rows.where("NOT (a <=> b)").count() == 0 and rows.count() == len(values)


def test_nearest_in_tiles(monkeypatch):
    """Candidates of many tiles, from both sides, with clusters of many sizes."""
    monkeypatch.setattr(L, "TILE", 5)
    monkeypatch.setattr(L, "AGAIN", 20)
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(90, 5)))
    c = np.concatenate([np.sort(rng.integers(0, 20, 45)), np.sort(rng.integers(20, 50, 45))])
    _, first, n = np.unique(c, return_index=True, return_counts=True)
    names = c[first]
    dirty = names % 3 > 0
    sums = np.add.reduceat(np.add.reduceat(np.clip(x @ x.T, 0, 1), first, axis=0), first, axis=1) / np.outer(n, n)
    np.fill_diagonal(sums, -1)

    def side(mask):
        rows = np.flatnonzero(mask)
        of = np.searchsorted(names, c[rows])
        return L._side(pa.table({"id": rows, "vec": x[rows].tolist(), "c": c[rows], "n": n[of], "dirty": dirty[of]}))

    one, two = side(c < 20), side(c >= 20)
    got = {}
    for batch in [*L._nearest(one.where(one.dirty), two, False, 0.2, True, True), *L._nearest(one.where(~one.dirty), two.where(two.dirty), False, 0.2, False, True)]:
        for r in batch.to_pylist():
            got[r["a"]] = max(got.get(r["a"], (-1, -1)), (round(r["s"] / r["pairs"], 12), r["b"]))
    same = {r["a"]: (round(r["s"] / r["pairs"], 12), r["b"]) for b in L._nearest(one.where(one.dirty), one, True, 0.2, True, False) for r in b.to_pylist()}
    for found, other in ((got, lambda a, b: (a < 20) != (b < 20)), (same, lambda a, b: a < 20 and b < 20)):
        able = np.array([[sums[i, j] if other(a, b) else -1 for j, b in enumerate(names)] for i, a in enumerate(names)])
        want = {int(a): (round(able[i].max(), 12), int(names[able[i].argmax()])) for i, a in enumerate(names) if dirty[i] and able[i].max() > 0.2}
        assert {a: found[a] for a in want} == want and len(want) > 10


def test_links_send_no_copies(spark, monkeypatch):
    """The components of all pairs at a threshold, from vectors that are written once; with structure some blocks don't meet."""
    sizes, write = {}, S.pack

    def noted(rows, block, name, *by, **k):
        sizes[name] = rows.count()
        out = write(rows, block, name, *by, **k)
        sizes["blocks"] = out.count()
        return out

    monkeypatch.setattr(S, "pack", noted)
    rng = np.random.default_rng(5)
    x = unit(np.concatenate([rng.normal(size=(60, 5)), np.repeat(unit(rng.normal(size=(6, 5))), 20, axis=0) + 0.02 * rng.normal(size=(120, 5))]))
    vec = spark.createDataFrame([(int(i) - 90, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    sim = np.clip(x @ x.T, 0, 1)
    for threshold, pivots, size in ((0.97, 40, 10), (0.97, 1, 25), (0.7, 3, 16), (0.0, 8, 30)):
        label = np.arange(180)
        while True:
            least = np.where(sim >= threshold, label[None, :], 180).min(axis=1)
            if (least == label).all():
                break
            label = np.minimum(least, label)
        found = S.linked(vec, threshold, pivots, size)
        assert "Exchange" not in plan_of(found) and sizes["points"] == 180 and sizes["blocks"] > 6
        edges = found.collect()
        root = {i - 90: i - 90 for i in range(180)}
        for _ in range(180):
            now = dict(root)
            for e in edges:
                now[e.a] = now[e.b] = min(now[e.a], now[e.b])
            if now == root:
                break
            root = now
        assert [root[i - 90] for i in range(180)] == [int(v) - 90 for v in label]
