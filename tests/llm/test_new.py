"""Spelling variants, Merkle manifests and page extraction against brute force on small fixtures."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import html_extract, merkle, spelling
from threatloom.llm.html_layouts import Writer

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_variants(docs, ratio=10):
    """(word, form, root, n, n_near, form_n) of documents (id, text), by the contract's own words."""
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    near, masks = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            masks[k, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if words[v] >= ratio * words[w]}
    rows = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return rows


def variants(df, **options):
    return {tuple(r[c] for c in COLUMNS) for r in spelling.group_variants(df, **options).collect()}


@pytest.fixture(scope="module")
def misspelt():
    """Chains of forms, ties, repeats at a word's start and end, doubled letters, nulls, a very long text and very long words."""
    rng = random.Random(3)
    letters = "abcdeé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    def damaged(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k] + w[k:]])
    texts = [" ".join(rng.choice(stems) if rng.random() < 0.7 else damaged(rng.choice(stems)) for _ in range(300)) for _ in range(30)]
    chain = "chainedword " * 2000 + "chainedwort " * 150 + "chainedwost " * 11 + "Chainedwos " * 2
    long = "".join(rng.choice(letters) for _ in range(300))
    edge = [long[:14], long[:13], long[:15], long[:8] + "q" + long[9:14], long[:60], long[:59], long[:61], long[:30] + "zz" + long[32:60], long[:30] + "z" + long[31:60], long, long[:200] + "q" + long[201:], long[1:], "é" * 70, "é" * 71, "x" * 5000, "x" * 5001]
    return [*enumerate(texts), (900, chain), (901, "tiedword tiedworda tiedwordb " * 2 + "tiedworda tiedwordb " * 20), (902, " ".join(edge * 2)), (903, None), (904, ""), (None, "nullish nullish"), (905, "short"), (906, " ".join(edge)), (906, " ".join(edge)), (907, "Ünïcode ÜNÏCODE ünïcode×word ünïcode×word")]


@pytest.mark.parametrize("long_from", [14, 8])
def test_spelling(spark, misspelt, long_from):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in misspelt], "doc_id long, text string, word string, n int").repartition(5)
    got, expected = variants(df, long_from=long_from), plain_variants(misspelt)
    assert got == expected
    chain = {w: (form, root) for w, form, root, *_ in got if w.startswith("chained")}
    assert chain["chainedwost"][1] == "chainedword"
    assert any(f is None and n for _, f, _, _, n, _ in got)


def test_spelling_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants(df) == set()
    assert variants(spark.createDataFrame([(1, None), (2, "a b c")], df.schema)) == set()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = lambda row: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(level):
        """All levels of a tree."""
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def proof(levels, at):
        for level in levels[:-1]:
            first = at - at % 8
            yield level[first:at], level[at + 1 : first + 8]
            at //= 8

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))
        trees[lang] = climb([hashed(r) for r in by_lang[lang]])
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for k, r in enumerate(by_lang[lang]):
            path = [*proof(trees[lang], k), *proof(top, at)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = hashed((*r[:4], r[4].translate(lower) if tampered and r[4] is not None else r[4]))
            for left, right in path:
                fold = sha(*left, fold, *right)
            proven = sha(*(x for left, right in path for x in [*left, *right]))
            out.append((r[0], hashed(r), trees[lang][-1][0], top[-1][0], proven, fold, fold == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "langs", "local"), [(700, 3, 4), (700, 3, 1), (75, 1, 1), (1, 1, 1), (90, 80, 1), (8, 1, 4), (513, 1, 1), (650, 2, 2)])
def test_merkle(spark, n, langs, local):
    rng = random.Random(n)
    names = [None, "", "en", "É", *(f"l{k:02}" for k in range(90))]
    rows = [(rng.choice([k, k, k, 5, None]), rng.choice(["a", None, ""]), names[rng.randrange(langs)], rng.choice([None, 7]), rng.choice([None, "", "Text É", f"T{k}", "Long " * 999])) for k in range(n)]
    rows += rows[: n // 3]  # repeated rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int").repartition(5)
    got = merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, local=local)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_merkle_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df).collect() == []


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return html_extract.train(html_extract.labelled_pages(pages, sample=200), steps=60)


def article(page):
    """The text of a page of the test tables, whose articles have h1 and p alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_html_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_extract.extract(pages, model).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_held_out(model):
    """Accuracy on layouts that training hasn't seen, of other words."""
    wrong = blocks = 0
    for seed in range(300):
        forest = html_extract.Forest()
        forest.page(0, Writer([f"w{k}" for k in range(300)], 10**7 + seed).page())
        parent, depth, kinds, label, places, ends = forest.arrays()
        p, _ = html_extract.marginals(model, parent, depth, kinds, places, ends)
        wrong += sum((p[e] > 0.5) != (label[e] == 1) for _, e, _ in forest.blocks)
        blocks += len(forest.blocks)
    assert wrong / blocks < 0.06


def test_html_marginals():
    """Sum-product against the sum over all labellings."""
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 3, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 3, 0, 1])
    kinds, places, ends = rng.integers(0, html_extract.N_EDGES, 8), np.arange(8), np.arange(1, 9)
    weights = rng.normal(size=html_extract.N_FEATURES + 4 * html_extract.N_EDGES)
    total, ones, joint = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for code in range(256):
        y = [code >> k & 1 for k in range(8)]
        score = sum(weights[places[k]] * y[k] for k in range(8)) + sum(weights[html_extract.N_FEATURES + 4 * kinds[k] + 2 * y[parent[k]] + y[k]] for k in range(8) if parent[k] >= 0)
        w = np.exp(score)
        total += w
        ones += w * np.array(y)
        for k in range(8):
            if parent[k] >= 0:
                joint[k, y[parent[k]], y[k]] += w
    p, j = html_extract.marginals(weights, parent, depth, kinds, places, ends)
    assert np.allclose(p, ones / total) and np.allclose(j, joint / total)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>one<p>two <b>bold<br>line</b> more", ["one", "two bold line more"]),
        ("a&amp;b &nbsp; &#x41;&copy<div>c</div>d<!-- no --> e", ["a&b A©", "c", "d e"]),
        ("<head><title>no</title><p>early body", ["early body"]),
        ("<script>var t='</p>'; <p>no</p></script><p>yes<style>x", ["yes"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("<nav><p>menu</nav><form>f<p>g</form><p a='>' b=\">\">x<hr>y", ["x", "y"]),
        ("<p>cut <b", ["cut"]),
        ("1 < 2 &lt;p&gt; </nothing> <P>Big</P>", ["1 < 2 <p>", "Big"]),
        ("", []),
    ],
)
def test_html_blocks(page, blocks):
    forest = html_extract.Forest()
    forest.page(0, page)
    assert [t for _, _, t in forest.blocks] == blocks


def test_html_cases(spark, model):
    long = "<article><h1>t</h1>" + "<p>Some words here, many of them.</p>" * 50_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>deep words</p>"
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (None, None, "<article><p>Some words.</p></article>", "x"), (4, "u", long, None), (4, "u", long, None), (5, "u", deep, "x"), (6, "u", "<nav><a href=x>menu</a></nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(df, model).collect()}
    assert got[1, "u"] == got[2, "u"] == got[6, "u"] == "" and got[None, None] == "Some words."
    assert got[4, "u"] == "\n\n".join(["t"] + ["Some words here, many of them."] * 50_000)
    assert html_extract.extract(df, model).count() == 7 and html_extract.extract(df.limit(0), model).count() == 0
    none = html_extract.train(spark.createDataFrame([], "html string"))
    assert {r.text for r in html_extract.extract(df, none).collect()} == {""}
