"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import chat, decontam, jaccard_join, lm_score, mixing, quality, sharding, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string, source string, n_words string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, blank, very long, tied, repeated and near-copied texts, with columns whose names clash."""
    rng = random.Random(5)
    base, other, long = prose(rng, 300), prose(rng, 260), prose(rng, 20_000, 5000)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (10, 120, 280)]
    half = " ".join(words[:150]) + " " + prose(rng, 150, 10_000)
    rows = [
        (1, base, "a", "x", "y"), (2, base, "a", "x", "y"), (2, base, "a", "x", "y"), (3, near[0], "a", "x", None), (4, near[1], "b", None, "y"), (5, near[2], None, "x", "y"),
        (6, None, "a", "x", "y"), (7, "", "a", "x", "y"), (8, " \t\n", None, None, None), (9, long, "c", "x", "y"), (10, other, "b", "x", "y"), (11, half, "b", "x", "y"), (None, other, "b", "x", "y"),
        (12, "short text", "a", "x", "y"), (13, "short text", "a", "x", "y"), (14, "tick " * 500, "a", "x", "y"), (15, "### $$$ %%% &&& " * 5, "d", "x", "y"), (16, "line one is here\n" * 8, "d", "x", "y"), (17, "é" * 900, "d", "x", "y"),
    ]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(frame):
    return frame.where("doc_id = -1")


def removed(rows):
    """Bytes covered by 400-byte strings that start elsewhere as well."""
    count = Counter(b[p : p + 400] for _, b in rows for p in range(len(b) - 399))
    out = []
    for _, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        out.append(gone)
    return out


def shared_bytes(rows):
    """Bytes of phrases in a row that other rows have, 128 bytes or more together, counted without ranks."""
    cut, holders = [], defaultdict(set)
    for row in rows:
        starts = suffix_dedup.phrases([row[1]])[0].tolist() if len(row[1]) >= 350 else []
        cut.append([(a, e + 16 if e < len(row[1]) else e) for a, e in zip(starts, [*starts[1:], len(row[1])])])
        for a, e in cut[-1]:
            holders[row[1][a:e]].add(row)
    out = []
    for (_, b), spans in zip(rows, cut):
        n, begin, end = 0, None, None
        for a, e in [*spans, (None, None)]:
            if a is not None and len(holders[b[a:e]]) > 1:
                begin, end = a if begin is None else begin, e
            elif begin is not None:
                n, begin = n + (end - begin if end - begin >= 128 else 0), None
        out.append(n)
    return out


def suffix_rows(rows):
    want = Counter()
    for (i, b), gone, shared in zip(rows, removed(rows), shared_bytes(rows), strict=True):
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest(), shared)] += 1
    return want


def suffix_got(frame):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_shared) for r in suffix_dedup.deduplicate(frame).collect())


def test_suffix(frame, docs, empty):
    assert suffix_got(frame) == suffix_rows([(i, (t or "").encode()) for i, t, *_ in docs])
    assert suffix_dedup.deduplicate(empty).count() == 0
    kept = {r.doc_id: bytes(r.kept_bytes) for r in suffix_dedup.deduplicate(frame, keep_text=True).collect()}
    assert kept[12] == b"short text" and kept[1] == b""


def test_suffix_passages(spark):
    """Passages around the thresholds at all kinds of places, inside one text and across, in periodic texts, too."""
    rng = random.Random(12)
    passages = {n: prose(rng, 200, 3000)[:n] for n in (200, 288, 300, 399, 400, 401, 470, 900)}
    rows, at = [], 0
    for n, p in passages.items():
        for before, after in ((0, 300), (300, 0), (150, 200), (7, 9)):
            rows.append((at, prose(rng, 60, 3000)[:before] + p + prose(rng, 60, 3000)[:after]))
            at += 1
    rows += [(90, passages[400] + " x " + passages[401] + " y " + passages[400]), (91, "ab" * 300 + "c"), (92, "z" + "ab" * 250), (93, "q" * 399), (94, "q" * 401), (95, "q" * 256 + "r"), (96, "é" * 128), (96, "é" * 128), (97, passages[900][100:800])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = suffix_got(df), suffix_rows([(i, t.encode()) for i, t in rows])
    assert got == want, (got - want, want - got)
    n_shared = {k[0]: k[5] for k in got}
    assert all(n_shared[i] for i in range(12, 32))  # every passage of 350 bytes or more
    alone = [(0, prose(rng, 400, 9000)), (1, prose(rng, 400, 9000)), (2, "tick " * 200)]
    assert {k[5] for k in suffix_got(spark.createDataFrame(alone, "doc_id long, text string"))} == {0}


def test_suffix_chunks(monkeypatch):
    """Long texts are hashed in chunks, with the same anchors."""
    rng = random.Random(13)
    data = (prose(rng, 2000, 3000) + "tick " * 300 + prose(rng, 500, 3000)).encode()
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 97)
    parts = suffix_dedup.anchors(data)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(whole[0]) > 100


def shingles(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def test_jaccard(frame, docs, empty):
    sets = [shingles(t) for _, t, *_ in docs]
    label, links = list(range(len(docs))), [0] * len(docs)
    for _ in docs:
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if x != y and a and 5 * len(a & b) >= 4 * len(a | b):
                    label[x] = label[y] = min(label[x], label[y])
    for x, a in enumerate(sets):
        links[x] = sum(1 for y, b in enumerate(sets) if x != y and a and 5 * len(a & b) >= 4 * len(a | b))
    least = {}
    for x, (i, *_) in enumerate(docs):
        least.setdefault(label[x], []).append(i)
    want = Counter((i, min((k for k in least[label[x]] if k is not None), default=None), links[x]) for x, (i, *_) in enumerate(docs))
    assert Counter(tuple(r) for r in jaccard_join.join(frame).collect()) == want
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.keep_one(frame)
    clash = frame.withColumns({c: F.lit(1) for c in ("r", "__row", "label", "n")})
    assert jaccard_join.keep_one(clash).columns == clash.columns and jaccard_join.keep_one(clash).count() == kept.count()
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17]


def test_jaccard_null_ids(spark):
    """Near, not equal, copies whose ids are all null are linked with each other and with documents that have one."""
    rng = random.Random(8)
    one, two = prose(rng, 200, 5000).split(), prose(rng, 200, 5000).split()
    change = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(1, " ".join(one)), (None, change(one, 50)), (None, " ".join(two)), (None, change(two, 90)), (2, prose(rng, 100, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.join(docs).collect())
    assert got == Counter({(1, 1, 1): 1, (None, 1, 1): 1, (None, None, 1): 2, (2, 2, 0): 1})
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert len(kept) == 3 and {(1, rows[0][1]), (2, rows[4][1])} < set(kept)


def test_jaccard_blocks(spark):
    """A group of near copies that spans several blocks."""
    rng = random.Random(3)
    base = prose(rng, 200, 5000).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), 1 + i % 4):
            w[k] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = {i: sum(1 for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in sets}
    got = {r.doc_id: r.n_links for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert got == links


def test_jaccard_wide_groups(spark, monkeypatch):
    """Groups wider than a block give the links that groups within one give: repeated rows, null ids, centers' texts broadcast or shuffled."""
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base = prose(rng, 150, 4000).split()
        for i in range(30):
            w = list(base)
            for k in rng.sample(range(150), i % 5):
                w[k] = f"z{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w + ["tail"] * (i % 3))))
    rows += [rows[4]] * 5 + [(None, rows[7][1])] * 3 + [(None, rows[40][1] + " more")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(tuple(r) for r in jaccard_join.join(df).collect())
    assert max(links for _, _, links in want) > 20
    assert Counter(tuple(r) for r in jaccard_join.join(df, block=4).collect()) == want
    monkeypatch.setattr(jaccard_join, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(jaccard_join, "KEPT_SHINGLES", 0)
    assert Counter(tuple(r) for r in jaccard_join.join(df, block=4).collect()) == want


def test_jaccard_deltas():
    """Sizes and common shingles from deltas to a center are those of the sets."""
    rng = np.random.default_rng(4)
    center = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    sets, rows = [], []
    for k in range(6):
        other = np.unique(rng.integers(0, 50, k * 5, dtype=np.uint64))
        sets.append(np.union1d(center[rng.random(len(center)) < 0.9 - k / 10], other))
        among = np.isin(sets[-1], center)
        rows.append((np.packbits(np.isin(center, sets[-1])).tobytes(), sets[-1][~among].tobytes()))
    sizes, both = jaccard_join._by_delta(rows)
    assert sizes.tolist() == [len(s) for s in sets]
    for (i, a), (j, b) in itertools.permutations(enumerate(sets), 2):  # a set with itself is never asked for
        assert both[i, j] == len(np.intersect1d(a, b))


def test_jaccard_forest(spark):
    """Prefixes stay deep where near copies differ little, and are shortened where they are at the threshold."""
    rng = random.Random(17)
    depths = {}
    for name, changed in (("little", 1), ("much", 4)):
        rows = []
        for g in range(40):
            base = prose(rng, 200, 9000).split()
            for c in range(3):
                w = list(base)
                for k in rng.sample(range(200), changed if c else 0):
                    w[k] = f"z{rng.randrange(10**6)}"
                rows.append((3 * g + c, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        signed = jaccard_join._signed(jaccard_join._rows(df, "doc_id", "text"), 20, 8)
        nodes = signed.withColumnRenamed("doc_id", "id").cache()
        pairs, depths[name] = jaccard_join.matched(nodes, 20, 8, 4, 0.8, 0.9999)
        sets = {i: shingles(t) for i, t in rows}
        links = {(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        got = {r.doc_id: r.n_links for r in jaccard_join.join(df).collect()}
        assert sum(got.values()) == 2 * len(links) and len(links) > 30
    assert 4 <= depths["much"] < depths["little"] <= 8
    chance = spark.range(1).select(jaccard_join.found_share(F.lit(0.8), 5, 20)).first()[0]
    assert abs(chance - (1 - (1 - 0.8**5) ** 20)) < 1e-9


def test_jaccard_covered():
    """A pair counts in the group of the least center that its nodes have in common."""
    got = jaccard_join._covered([[1, 5], [1, 5, 7], [5], [2, 5]], 5)
    assert got.tolist() == [[True, True, False, False], [True, True, False, False], [False, False, False, False], [False, False, False, True]]


def test_quality(frame, docs, empty):
    rows = quality.apply_policy(quality.ledger(frame))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows.collect())
    want = Counter()
    for i, t, *_ in docs:
        t = t or ""
        w = WORDS.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + d for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))] += 1
    assert got == want
    assert quality.ledger(empty).count() == 0
    kept = quality.keep(frame)
    assert kept.columns == frame.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(d for d, k in zip(frame.collect(), [r.kept for r in rows.collect()]) if k)
    assert quality.keep(empty).count() == 0
    clash = frame.selectExpr("doc_id", "text", "'x' AS KEPT", "1 AS fail_bits", "2 AS __w", "3 AS Policy")
    assert quality.keep(clash).columns == clash.columns and quality.apply_policy(quality.ledger(clash)).where("kept").count() == kept.count()
    table = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for version, mask in quality.POLICIES.items():
        for k, (name, _) in enumerate(quality.RULES):
            if mask >> k & 1:
                r = table[(version, name)]
                assert r.failed == sum(b >> k & 1 for b in bits)
                assert r.only_this == sum(b & mask == 1 << k for b in bits)
                assert r.kept_without == sum(b & mask & ~(1 << k) == 0 for b in bits)


def test_quality_rules(spark):
    """Each rule of the ledger on a text that fails it."""
    prose_ = "the cat and the dog went to that place of old with them\n" * 1
    texts = {"bullets": "\n".join(f"- the word number {i} of and" for i in range(9)), "ellipses": "\n".join(f"the word {i} of and ..." for i in range(9)), "few_letters": "the of " + "1 2 3 4 5 6 7 8 9 " * 3, "few_stop_words": "uno due tre quattro cinque sei sette otto nove dieci undici", "mean_line": "the\nof\na\nb\nc\nd\ne\nf\ng\nh\ni"}
    df = spark.createDataFrame([(0, prose_)] + [(k + 1, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(df).collect()}
    place = {name: k for k, (name, _) in enumerate(quality.RULES)}
    assert bits[0] >> 5 == 0
    for k, name in enumerate(texts):
        assert bits[k + 1] >> place[name] & 1, name


def test_url_length(spark):
    """A very long url doesn't hold up or swell the others, and is judged by the same masks."""
    import time

    urls = [f"http://a{i}.net/x" for i in range(3000)] + ["http://b.net/" + "y" * 2_000_000 + "/wp-login.php", "http://casino.net/" + "é" * 3000]
    auto, began = url_filter.compile_globs([g for g, _ in url_filter.GLOBS]), time.time()
    hits = url_filter.run(auto, [f".{u[7:]}".encode() for u in urls])
    assert time.time() - began < 20 and hits[:3000].sum() == 0 and hits[3000].tolist() == [False] * 5 + [True] and hits[3001][0]


def test_url_ties(spark):
    """Of rules of equal length the earlier decides."""
    df = spark.createDataFrame([(1, "http://a.org/b", "r")], "page_id long, url string, rule string")
    for rules in ([("org", "/b", "block"), ("a.org", "", "allow")], [("a.org", "", "allow"), ("org", "/b", "block")]):
        rules = [(h, p, v) for h, p, v in rules if len(h + p) == 5]
        assert url_filter.filter_urls(df, host_rules=rules).first().verdict == rules[0][2]


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http:///fr/x", "https://A.Example.ORG/es/1", "https://example.org/en/12?x=/es/", "https://example.org/en/2", "https://badexample.org/es/", "http://x.com/de/a", "http://x.com/fr/a#b",
        "http://x.com", "http://x.com?/fr/", "http://casino.example.net/a", "http://net/casino", "http://a.cheap-pills.info/p", "http://cheap-pills.info:80/p", "http://org/", "http://user@org/x", "ftp://é.org/é", "x" * 5000 + "://org/y",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[1], max(fit)[2]
        bad = "casino" in host or re.search(r"\.(cheap-pills|free-bets|spam-farm|ads-track)\.", "." + host) or "/wp-login.php" in path
        return host, path, None, "block" if bad else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.where("page_id < 0")).count() == 0


def test_automaton_words():
    """More bits than one word holds, against regular expressions."""
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**"]) for _ in range(9)) + "a" for _ in range(30)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(14))) for _ in range(200)]

    def to_regex(g):
        return re.compile("".join(".*" if len(p) > 1 and "**" in p else "[^/]*" if p[0] == "*" else re.escape(p) for p in re.findall(r"\*+|[^*]", g)) + r"\Z")

    hits = url_filter.run(url_filter.compile_globs(globs), [t.encode() for t in texts])
    for k, g in enumerate(globs):
        if any(len(p) % 2 for p in re.findall(r"\*{3,}", g)):
            continue
        for t, row in zip(texts, hits, strict=True):
            assert row[k] == bool(to_regex(g).match(t)), (g, t)


def test_warc(spark, tmp_path):
    big = "x" * 150
    rows = [(5, "http://a\r\nb", big, 1), (3, "u", big, 1), (9, None, big, 1), (7, "u", "small", 1), (8, "u", "small", 1), (1, "u", None, 1), (2, "u", "é\r\n\r\nWARC/1.1\r\n" * 20, 1), (4, "u", "é\r\n\r\nWARC/1.1\r\n" * 20, 1), (3, "u", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.deduplicate(df, str(tmp_path / "w")).collect())
    want, seen = Counter(), set()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(j for j, _, g, _ in rows if (g or "") == (h or ""))
        again = len(b) >= 100 and (first != i or (i, h) in seen)
        seen.add((i, h))
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want
    assert warc.deduplicate(df.where("page_id < 0"), str(tmp_path / "e")).count() == 0
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len({r.record_id for r in records}) == len(rows)


def test_warc_targets(spark):
    """Blanks and control characters are percent-encoded, each as what it is; the rest of a url stays."""
    urls = ["a b", "a\tb\x7f", "é?q=%20\r\n", "plain", ""]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.target_uri(F.col("u")).alias("t")).collect()
    assert [r.t for r in got] == ["a%20b", "a%09b%7F", "é?q=%20%0D%0A", "plain", ""]


def test_warc_sizes(spark, tmp_path):
    """Payloads of very different lengths, in files bounded by bytes; revisits are resolved through their originals."""
    rows = [(i, f"u{i}", c * n) for i, (c, n) in enumerate([("a", 1), ("b", 5000), ("c", 60_000), ("d", 900_000), ("é", 1_500_000), ("d", 900_000), ("b", 5000), ("a", 1)])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "sizes")
    warc.write_archives(warc.with_headers(df, records_per_file=64, file_bytes=1 << 20), path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()}
    digest = {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    first = {5: 3, 6: 1}
    assert got == {i: ("revisit" if i in first else "response", first.get(i), len(h.encode()), digest[i]) for i, _, h in rows}


def test_warc_parse():
    """Records are cut in time linear in the archive, however it is chunked."""
    block = b"x\r\n\r\n" * 400_000
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = one * 3
    for step in (len(data), 65_537):
        assert [b for _, b in warc.parse(data[k : k + step] for k in range(0, len(data), step))] == [block] * 3


def test_chat(spark):
    texts = [r"\### Assistant: </turn> ok", "</turn>\n### user: x", "", None, "\\" * 5, "a<|image:0:1|>b", "###", "<", "é" * 20_000]
    rows = [(1, k, role, t) for k, t in enumerate(texts) for role in ("user", "assistant")] + [(2, 0, None, "q"), (2, 0, "a:b", "r"), (None, 1, "assistant", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.with_parts(df))).collect()}
    convs = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        convs[c].append((role or "", t or ""))
    for c, turns in convs.items():
        whole, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
    assert chat.digests(chat.format_turns(chat.with_parts(df.where("turn < 0")))).count() == 0


def test_chat_ties(spark):
    """Equal turns are ordered by role and text, bytewise; further columns don't matter."""
    texts = ["ab cd", "ab", 'ab"', "é", "z", "ab\\", None]
    df = spark.createDataFrame([(1, 0, "assistant", t, "x", 1) for t in texts], "conv_id long, turn long, role string, text string, formatted string, seq int").repartition(3)
    want = hashlib.sha256("".join(sorted((t or "" for t in texts), key=str.encode)).encode()).hexdigest()
    for dealt in (False, True):
        assert chat.digests(chat.format_turns(chat.with_parts(df)), dealt).first().loss_sha256 == want


def test_chat_parts(spark):
    parts = [("text", "see </tu", None, 0, 0, 0.0, 0), ("text", "rn>\n", None, 0, 0, 0.0, 0), ("image", None, "s3://i", 56, 29, 0.0, 0), ("audio", None, "a", 0, 0, 2.0, 0), ("document", None, None, 0, 0, 0.0, 3), ("odd", None, "z", 0, 0, 0.0, 0), ("text", "end", None, 0, 0, 0.0, 0)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert [(a.type, a.ref, a.n_tokens) for a in r.attachments] == [("image", "s3://i", 4), ("audio", "a", 50), ("document", "", 1536), ("file", "z", 1)]
    assert [r.formatted[a.start : a.end] for a in r.attachments] == ["<|image:0:4|>", "<|audio:1:50|>", "<|document:2:1536|>", "<|file:3:1|>"]
    assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss) == "see </turn>\nend"
    assert list(chat.parse(r.formatted))[0][0] == "assistant"


def test_decontam(spark, frame, docs, empty):
    rng = random.Random(9)
    text = dict((i, t) for i, t, *_ in docs)
    items = [(1, " ".join(text[10].upper().split()[20:45])), (2, "Short, TEXT!"), (3, None), (4, "?!"), (None, text[10]), (5, prose(rng, 30, 9000)), (1, "tick tick"), (6, " ".join(text[9].split()[-12:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = defaultdict(set)
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            grams[tuple(w[k : k + 10])] |= {i} - {None}  # a null id marks words alone
    want = Counter()
    for i, t, *_ in docs:
        w = norm(t)
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k : k + n])]
        names = ",".join(sorted(map(str, ids)))
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit))] += 1
    assert any(r[3] == 0 and r[5] for r in want)
    for block in (decontam.BLOCK_WINDOWS, 20):
        rows = decontam.contamination(frame, bench, block_windows=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
    for r in rows:
        if r.doc_id == 12:
            assert [text[12].encode()[a:b] for a, b in r.spans] == [b"short text"]
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(frame, bench.where("item_id < 0")).where("contaminated").count() == 0
    assert decontam.clean(frame, bench).columns == frame.columns


def test_decontam_blocks_of_ties(spark):
    """Rows that tie in id and text keep their own columns, and their number, with many blocks."""
    rng = random.Random(8)
    bad, good = prose(rng, 30, 9000), prose(rng, 30, 9000)
    bench = spark.createDataFrame([(1, bad)] + [(k, prose(rng, 30, 9000)) for k in range(2, 9)], "item_id long, text string")
    df = spark.createDataFrame([(7, t, i) for i in range(60) for t in (bad, good)], "doc_id long, text string, runs int").repartition(5)
    assert len(decontam._blocks(decontam.windows(bench, "item_id", "text"), 40)) > 3
    kept = decontam.clean(df, bench, block_windows=40)
    assert sorted(map(tuple, kept.collect())) == [(7, good, i) for i in range(60)]


def test_decontam_blocks_of_one_id(spark):
    """Windows of one item are dealt over blocks, too."""
    bench = spark.createDataFrame([(1, prose(random.Random(6), 500, 9000))], "item_id long, text string")
    blocks = [b.count() for b in decontam._blocks(decontam.windows(bench, "item_id", "text"), 50)]
    assert sum(blocks) == 491 and len(blocks) == 10 and max(blocks) < 100


def test_decontam_nodes():
    """An automaton has at most 30 nodes a window, however long the words are, and far below a gigabyte for a whole block."""
    rng = random.Random(7)
    ws = ["".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(20_000)]
    text = [rng.choice(ws) for _ in range(20_009)]
    matcher = decontam.Matcher([(" ".join(text[k : k + 10]), [str(k)]) for k in range(20_000)])
    stats = matcher.auto.get_stats()
    assert stats["nodes_count"] <= 30 * 20_000 + 1
    assert stats["total_size"] * decontam.BLOCK_WINDOWS / 20_000 < 400 << 20
    n, runs, ids = matcher.scan(" ".join(["Other", *text[5:17], "more"]))
    assert (n, runs, ids) == (14, [(1, 13)], {"5", "6", "7"})


def test_lm(spark, frame, empty):
    rng = random.Random(2)
    good = [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50))) for i in range(30)]
    bad = [(200 + i, " ".join(rng.choice(["delta", "omega", "sigma"]) for _ in range(50))) for i in range(60)]
    df = spark.createDataFrame([*good, *bad, (1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:20]] + [(i, 0, 0) for i, _ in bad[:20]] + [(None, 1, 0), (100, 1, 0), (201, 1, 1), (202, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels).collect()}
    assert max(rows[i].ce_difference for i, _ in good) < min(rows[i].ce_difference for i, _ in bad)  # ten of each kind weren't labelled
    assert (rows[1].n_tokens, rows[1].ce_difference, rows[2].n_tokens) == (0, 0.0, 0)
    # brute force of two documents' losses from exact counts; words of the vocabulary, all others are one word
    texts = {i: (t or "").split() for i, t in [*good, *bad]}
    vocabulary = {w for w, n in Counter(w for i, _ in good[:20] for w in texts[i]).items() if n >= lm_score.MIN_COUNT}
    assert len(lm_score.vocabulary(df.where("doc_id between 100 and 119").select("text"))) == len(vocabulary) == 3
    texts = {i: [w if w in vocabulary else "<unk>" for w in t] for i, t in texts.items()}
    import math

    for name, ids in (("background_loss", list(texts)), ("target_loss", [i for i, _ in good[:20]])):
        uni, bi, begins = Counter(), Counter(), len(ids)
        for i in ids:
            uni.update(texts[i])
            bi.update(zip([None, *texts[i]], texts[i]))
        for doc in (105, 200):
            loss = 0.0
            for h, w in zip([None, *texts[doc]], texts[doc]):
                p1 = (uni[w] + lm_score.ADD) / (sum(uni.values()) + lm_score.ADD * (len(vocabulary) + 1))
                loss -= math.log((bi[(h, w)] + lm_score.PRIOR * p1) / ((begins if h is None else uni[h]) + lm_score.PRIOR))
            assert abs(rows[doc][name] - loss / 50) < 1e-8
    assert lm_score.score(empty, lm_score.train(empty, labels)).count() == 0
    assert {r.ce_difference for r in lm_score.cross_entropy_difference(df.where("doc_id < 3"), labels.where("quality = 7")).collect()} == {0.0}


def test_lm_cases(spark, frame, docs):
    """Nulls, empty, long and repeated texts, null ids and clashing columns: all losses against brute force."""
    import math

    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (10, 1, None), (14, 0, 0)], "doc_id long, quality int, toxic int")
    rows = lm_score.cross_entropy_difference(frame, labels).collect()
    split = [(d[0], WORDS.findall(d[1] or "")) for d in docs]
    sample = [w for i, w in split if i in (1, 9, 10)]
    vocabulary = {w for w, n in Counter(w for t in sample for w in t).items() if n >= lm_score.MIN_COUNT}
    want = []
    models = []
    for texts in (sample, [w for _, w in split]):
        texts = [[w if w in vocabulary else "<unk>" for w in t] for t in texts]
        uni, bi = Counter(w for t in texts for w in t), Counter(x for t in texts for x in zip([None, *t], t))
        models.append((uni, bi, sum(map(bool, texts)), sum(uni.values())))
    for i, t in split:
        t, sums = [w if w in vocabulary else "<unk>" for w in t], []
        for uni, bi, begins, total in models:
            p1 = lambda w: (uni[w] + lm_score.ADD) / (total + lm_score.ADD * (len(vocabulary) + 1))  # noqa: E731, B023
            sums.append(-sum(math.log((bi[h, w] + lm_score.PRIOR * p1(w)) / ((begins if h is None else uni[h]) + lm_score.PRIOR)) for h, w in zip([None, *t], t)) / max(1, len(t)))
        want.append((i, len(t), *sums))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(rows) == len(want)
    for r, w in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert tuple(r[:2]) == w[:2]
        assert abs(r.target_loss - w[2]) < 1e-6 and abs(r.background_loss - w[3]) < 1e-6 and abs(r.ce_difference - (w[2] - w[3])) < 1e-6


def test_lm_salts(spark, monkeypatch):
    """Slices of many tokens are answered for in several tasks, and counts added up in two steps, with the same losses."""
    rng = random.Random(23)
    df = spark.createDataFrame([(i, prose(rng, 60, 40)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    want = {tuple(r) for r in lm_score.cross_entropy_difference(df, labels).collect()}
    for name, value in (("SALT_TOKENS", 20), ("SLICE_BYTES", 1000), ("MAX_SLICES", 8), ("MIN_SLICES", 4)):
        monkeypatch.setattr(lm_score, name, value)
    models = lm_score.train(df, labels)
    assert models.salts.count() > 4 and models.salts.agg(F.max("n_salts")).first()[0] > 2
    assert {tuple(r) for r in lm_score.score(df, models).collect()} == want


def test_stages(spark, frame, empty):
    """Every stage of the pipeline on nulls, repeats, clashing names and an empty table."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    extra = frame.withColumns({c: F.lit(7) for c in ("kept", "epoch", "runs", "r", "slot", "lang", "n_chars")})
    for name, stage in corpus_pipeline.STAGES:
        for docs, some in ((extra, True), (empty.withColumn("epoch", F.lit(1)), False)):
            out = stage(spark, docs, sf_dir)
            assert (out.count() > 0) == some, name
            if name != "shards":
                assert out.columns == docs.columns, name


def test_mixing(spark, frame, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20 + rng.randrange(30)), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 120 + ["low"] * 30 + [None] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, target_entropy=0.9, max_epochs=4.0).collect()
    tokens = {i: len(t.split()) for i, t, _ in rows}
    total, by = Counter(), {i: s for i, _, s in rows}
    for i, t, s in rows:
        total[s] += tokens[i]
    assert {r.doc_id for r in out} == set(tokens)  # every source whole at least once
    import math

    exponent = mixing.find_exponent(spark.createDataFrame([(str(s), n) for s, n in total.items()], "source string, tokens long"), 0.9, 4.0)
    z = sum(n**exponent for n in total.values())
    assert math.log(max(total.values()) / min(total.values())) * (1 - exponent) <= math.log(4) + 1e-9
    per = max(n / n**exponent for n in total.values())
    got = Counter()
    for r in out:
        assert abs(r.weight - total[by[r.doc_id]] ** exponent / z) < 1e-6
        got[r.source] += r.n_tokens
    for s, n in total.items():
        assert n**exponent * per - 1e-3 <= got[s] < n**exponent * per + 51
    assert Counter(r.doc_id for r in out).most_common(1)[0][1] <= 4
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(frame).count() >= frame.count()


def hashes(spark, rows, kinds):
    """xxhash64 of each tuple, as Spark computes it: the only thing that the versions below take from the library's side."""
    names = [f"k{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).withColumn("h", F.xxhash64(*names))
    return {tuple(r)[:-1]: r.h for r in df.collect()}


@pytest.mark.parametrize("block_tokens", [1 << 22, 4])
def test_mixing_rows(spark, block_tokens):
    """Which copy, epoch and block each document gets, row by row, against a plain version; clashing and null columns, too."""
    import math

    rng = random.Random(21)
    rows = [(i if i % 50 else None, prose(rng, 3 + rng.randrange(9)) if i % 40 else None, s, "own") for i, s in enumerate(["big"] * 160 + ["mid"] * 70 + [None] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Epoch string").repartition(3)
    got = Counter((r.doc_id, r.text, r.source, r.n_tokens, r.epoch, r.block, r["copy"]) for r in mixing.mix(df, target_entropy=0.95, max_epochs=3.0, block_tokens=block_tokens).collect())
    size = [max(1, len((t or "").split())) for _, t, *_ in rows]
    key = ["null" if s is None else f"s:{s}" for _, _, s, _ in rows]
    h = hashes(spark, [(i, t, "mix") for i, t in {r[:2] for r in rows}], ["long", "string", "string"])
    total = Counter()
    for n, k in zip(size, key):
        total[k] += n
    exponent = mixing.find_exponent(spark.createDataFrame(list(total.items()), "source string, tokens long"), 0.95, 3.0)
    per = max(n / n**exponent for n in total.values())
    want = Counter()
    for s, n in total.items():
        blocks = 64 * 2 ** max(0, math.ceil(math.log2(n / (64 * block_tokens))))
        mine = [(h[(r[0], r[1], "mix")], r, m) for r, m, k in zip(rows, size, key) if k == s]
        held = Counter()
        for x, _, m in mine:
            held[x % blocks] += m
        epochs = n**exponent * per / n
        budget, copies = round(epochs) * n if abs(epochs - round(epochs)) < 1e-6 else round(epochs * n, 3), Counter()
        epochs = max(1, math.ceil(budget / n))
        place = hashes(spark, [(s, e, b) for e in range(epochs) for b in held], ["string", "int", "long"])
        for e in range(epochs):
            left, before = min(n, budget - e * n), 0
            for k, b in enumerate(sorted(held, key=lambda b: (place[(s, e, b)], b))):
                if before >= left:
                    break
                inside, at = sorted((x for x in mine if x[0] % blocks == b), key=lambda x: x[0]), 0
                for x, group in itertools.groupby(inside, key=lambda x: x[0]):
                    for nth, (_, r, m) in enumerate(group):
                        if before + held[b] > left and at >= left - before:
                            break
                        at += m
                        want[(r[0], r[1], r[2], m, e, k, copies[x, nth])] += 1
                        copies[x, nth] += 1
                before += held[b]
    assert got == want, (len(got), len(want), list((got - want).items())[:3], list((want - got).items())[:3])
    alone = mixing.mix(df, target_entropy=0.95, max_epochs=3.0, block_tokens=block_tokens, with_results=False)
    assert alone.columns == df.columns and alone.count() == sum(got.values())


def test_mixing_equal_rows(spark):
    """Null ids and equal rows don't blur a budget: it is exceeded by less than one document."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    rows = [(None if i % 3 == 0 else i, text(0 if i % 3 == 1 else i), "s" if i % 2 else "t") for i in range(1200)] + [(5, text("same"), "s")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for budget in (4444, 9990):
        out = mixing.mix(df, budget=budget, target_entropy=1.0).collect()
        taken = Counter()
        for r in out:
            taken[r.source, r.weight] += r.n_tokens
        assert len(taken) == 2 and all(-1e-3 <= n - budget * weight < 10 for (_, weight), n in taken.items()), taken


def test_mixing_budget(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    out = mixing.mix(df, budget=90).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert 90 <= sum(r.n for r in out) < 96


def test_sharding(frame, docs, empty):
    rows = sharding.shard(frame).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharding.shard(empty).count() == 0
    assert set(frame.columns) <= set(sharding.shard(frame, keep_columns=True).columns)


def test_sharding_rows(spark):
    """Regions, racks, shards, slots and growth, row by row, against a plain version."""
    import math

    rng = random.Random(22)
    rows = [(rng.choice([None, 1, *range(300)]), prose(rng, rng.randrange(4)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3)
    names = [f"region/{r}" for r in range(2)] + [f"rack/{k}" for k in range(4)] + [f"shard/{s}" for s in range(8)] + ["late/8", "slot"]
    h = hashes(spark, [(i, n) for i in {r[0] for r in rows} for n in names], ["long", "string"])
    draw = lambda i, n, w: -math.log((((h[(i, n)] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)) / w

    def path(i):
        region = min(range(2), key=lambda r: draw(i, f"region/{r}", 4.0))
        rack = min(range(2 * region, 2 * region + 2), key=lambda k: draw(i, f"rack/{k}", 2.0))
        shard = min(range(2 * rack, 2 * rack + 2), key=lambda s: draw(i, f"shard/{s}", 1.0))
        return shard, 8 if draw(i, "late/8", 1.0) < draw(i, f"region/{region}", 4.0) else shard

    placed = [(path(i)[0], h[(i, "slot")] % 1024, (i is not None, i or 0), len(t.encode()) + 1, zlib.crc32(t.encode()), path(i)[1], i) for i, t, _ in rows]
    want = Counter()
    for s in range(8):
        for slot, (_, _, _, size, crc, grown, i) in enumerate(sorted(p for p in placed if p[0] == s), start=0):
            want[(i, size, crc, s, slot, grown)] += 1
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.grown_shard) for r in sharding.shard(df).collect())
    assert got == want


def test_sharding_growth_and_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("k"))
    a, b, c = (sharding.shard_of(F.col("k"), n) for n in (8, 9, 10))
    rows = ids.select(a.alias("a"), b.alias("b"), c.alias("c")).collect()
    assert all(r.b in (r.a, 8) and r.c in (r.b, 9) for r in rows)
    assert all(2200 < n < 2800 for n in Counter(r.a for r in rows).values()) and 1900 < sum(r.b == 8 for r in rows) < 2550
    w = [1.0] * 7 + [3.0]
    heavy = ids.select(a.alias("a"), sharding.shard_of(F.col("k"), 8, w).alias("b")).collect()
    assert 5500 < sum(r.b == 7 for r in heavy) < 6500
    assert all(r.b in (4, 5, 6, 7) for r in heavy if r.a != r.b)  # rows move into the region that grew alone
