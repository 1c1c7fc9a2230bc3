"""Registered queries against their SQL and a brute-force pipeline, over the smallest tables."""

import pytest

from tests.compare import assert_same, connect
from threatloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    assert_same(Q.queries()[name](spark, SF).toPandas(), connect(SF).sql(Q.oracle_sql()[name]).df())


def test_pipeline(spark):
    import corpus_pipeline as P
    from threatloom.llm import decontam, quality

    c = connect(SF)
    kept = {r[0] for r in c.sql(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    texts = dict(c.sql("SELECT doc_id, text FROM documents").fetchall())
    words = {i: texts[i].split() for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    label = {i: i for i in kept}
    for _ in range(5):
        for i in kept:
            for j in kept:
                if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    firsts = {i for i in kept if label[i] == i}
    clean = firsts - {r[0] for r in c.sql(f"SELECT doc_id FROM ({decontam.ORACLE_SQL}) WHERE contaminated").fetchall()}
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == clean
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixing", "shards"]
