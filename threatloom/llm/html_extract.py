"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its DOM elements. Every element has a hidden label, content or not. Node potentials are linear in
features of the element (name, words of class, id and role, its parent's name, length, share of link text, punctuation); edge potentials
depend on the labels of parent and child and on both names. Sum-product messages run upward and downward over the
forest of a batch of pages, a depth at a time, and give exact marginals: a block of text is main text if its element's marginal is
above one half. The parameters are fitted by gradient ascent on the likelihood of labelled pages, whose gradient is observed
minus expected features, the expectations being the same messages; each step is one Spark aggregation over the written, parsed sample.

Labelled pages are html whose elements carry ``data-main="1"`` (main text from here down) or ``data-main="0"`` (none from here
down). ``labelled_pages`` makes them from the words of a bounded sample of the given pages, in many layouts.

Text is taken in blocks: runs between the boundaries of block-level elements; inline elements and line breaks stay inside.
Scripts, styles, comments, forms and other elements that hold no prose give no text whatever their marginal is.

Cases: a null or empty page gives an empty text; a page that is cut off ends where it ends; unclosed and misnested elements are
closed as HTML has it for paragraphs, items, cells and options; text without any element is a block of the root; very long and
very deep pages are read whole; repeated rows give a row each; an empty table gives no rows; a model of no labelled page takes
nothing for content; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Pages whose words labelled pages are made of; the bound of the training sample.
SAMPLE = 400
STEPS, RATE, RIDGE = 80, 0.4, 2e-5
#: Places of hashed features, and kinds of edges (hashed names of child and parent).
N_FEATURES, N_EDGES = 1 << 12, 1 << 8
BATCH_CHARS = 4 << 20

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("script style head title template noscript form button input select option optgroup textarea iframe noembed noframes object svg math canvas audio video datalist nav dialog menu".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: An opening element closes the nearest open one of these, up to the element that bounds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
P_CLOSERS = BLOCKS - frozenset("body head html legend optgroup option select td tbody th thead tfoot tr title canvas button".split())
P_BOUNDS = frozenset("table td th button object caption html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|</?[A-Za-z][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Forest:
    """Elements of a batch of pages: parents (-1 at roots), depths, features, edge kinds, labels and blocks of text."""

    def __init__(self):
        self.parent, self.depth, self.names, self.marks, self.label = [], [], [], [], []
        self.letters, self.linked, self.points, self.parts = [], [], [], []
        self.blocks: list[tuple[int, int, str]] = []  # page, element, text

    def add(self, parent: int, name: str, marks: list[str], label: int | None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(name)
        self.marks.append(marks)
        self.label.append(label if label is not None else self.label[parent] if parent >= 0 else 0)
        for counts in (self.letters, self.linked, self.points, self.parts):
            counts.append(0)
        return len(self.parent) - 1

    def page(self, page: int, html: str) -> None:
        """Parse a page."""
        open_ = [self.add(-1, "#root", [], None)]
        silent, links, text, at = 0, 0, [], 0
        block = open_[0]
        now = Counter()  # open elements by name

        def flush(next_block: int) -> None:
            nonlocal text, block
            said = " ".join("".join(text).split())
            if said:
                self.blocks.append((page, block, said))
                self.letters[block] += len(said)
                self.points[block] += sum(map(said.count, ".,;:!?"))
                self.parts[block] += 1
            text, block = [], next_block

        def close(count: int) -> None:
            nonlocal silent, links
            for _ in range(count):
                e = open_.pop()
                now[self.names[e]] -= 1
                silent -= self.names[e] in SILENT
                links -= self.names[e] == "a"

        def nearest() -> int:
            return next(e for e in reversed(open_) if self.names[e] in BLOCKS or self.names[e] == "#root")

        def close_nearest(names, bounds) -> None:
            for k in range(len(open_) - 1, 0, -1) if any(now[n] for n in names) else ():
                if self.names[open_[k]] in names:
                    close(len(open_) - k)
                    return
                if self.names[open_[k]] in bounds:
                    return

        def say(raw: str) -> None:
            if raw and not silent:
                said = unescape(raw)
                text.append(said)
                if links:
                    self.linked[block] += len(said.strip())

        while True:
            m = _TOKEN.search(html, at)
            if not m:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.end()
            if not m[1]:
                continue
            name, ending = m[1].lower(), m[0][1] == "/"
            if ending:
                place = next((k for k in range(len(open_) - 1, 0, -1) if self.names[open_[k]] == name), 0) if now[name] else 0
                if name in BLOCKS:
                    flush(block)
                if place:
                    close(len(open_) - place)
                block = nearest() if name in BLOCKS else block
            elif name == "br":
                text.append(" ")
            elif name in VOID:
                if name == "hr":
                    close_nearest({"p"}, P_BOUNDS)
                    flush(nearest())
            else:
                if name in BLOCKS:
                    flush(block)
                if now["head"] and name not in HEAD and self.names[open_[-1]] == "head":
                    close(1)
                if name in P_CLOSERS:
                    close_nearest({"p"}, P_BOUNDS)
                if name in CLOSES:
                    close_nearest(*CLOSES[name])
                found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[2])} if m[2] else {}
                marks = [w.lower() for k in ("class", "id", "role", "aria-label", "itemprop") if k in found for w in _WORDS.findall(found[k])][:16]
                label = found.get("data-main")
                e = self.add(open_[-1], name, marks, int(label) if label in ("0", "1") else None)
                if m[0][-2] == "/" and name in ("svg", "math", "path", "object"):
                    continue
                if "hidden" in m[2] and re.search(r"\shidden(?=[\s=/]|$)", m[2]):
                    self.marks[e].append("hidden")
                open_.append(e)
                now[name] += 1
                silent += name in SILENT
                links += name == "a"
                if name in BLOCKS:
                    block = e
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(html, at)
                    at = end.start() if end else len(html)
        flush(0)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """parent, depth, edge kind and label of each element, and its features: places (CSR) of N_FEATURES."""
        parent, depth = np.array(self.parent, np.int64), np.array(self.depth, np.int64)
        ups = [self.names[p] if p >= 0 else "-" for p in self.parent]
        kinds = np.array([zlib.crc32(f"{n}<{u}".encode()) % N_EDGES for n, u in zip(self.names, ups, strict=True)], np.int64)
        total, link, below = np.array(self.letters, np.int64), np.array(self.linked, np.int64), np.array(self.parts, np.int64)
        order, starts = by_depth(depth)
        for d in range(len(starts) - 2, 0, -1):  # what elements hold with all below
            at = order[starts[d] : starts[d + 1]]
            for x in (total, link, below):
                np.add.at(x, parent[at], x[at])
        places, ends = [], []
        for e, name in enumerate(self.names):
            if self.parent[e] < 0:  # a page begins; its elements follow
                end = next((k for k in range(e + 1, len(ups)) if self.parent[k] < 0), len(ups))
                has = "".join(x[0] for x in ("article", "main", "h1") if x in self.names[e:end])
            up = ups[e]
            n, t = self.letters[e], int(total[e])
            share = int(4 * min(link[e] / t, 1)) if t else 5
            said = [f"n:{name}", f"p:{name}<{up}", f"own:{min(n, 1 << 20).bit_length() // 2}", f"all:{min(t, 1 << 20).bit_length() // 2}", f"link:{share}", f"link:{share}:{name}"]
            said.append(f"points:{min(8, int(100 * self.points[e] / n))}" if n else "points:-")
            said.append(f"has:{has}:{name}<{up}")
            said.append(f"blocks:{min(int(below[e]), 1 << 10).bit_length()}")
            said += [f"m:{w}" for w in self.marks[e]]
            if self.marks[e]:
                said.append("marked")
            places += [zlib.crc32(s.encode()) % N_FEATURES for s in said]
            ends.append(len(places))
        return parent, depth, kinds, np.array(self.label, np.int64), np.array(places, np.int64), np.array(ends, np.int64)


def by_depth(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements in order of depth, and where each depth begins (one more entry than depths)."""
    order = np.argsort(depth, kind="stable")
    return order, np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))


def marginals(weights: np.ndarray, parent: np.ndarray, depth: np.ndarray, kinds: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each element, and P(parent's label, child's label) of each edge (as rows of four), by sum-product in logarithms.

    weights: N_FEATURES of content, then four of each kind of edge. Messages of one depth are computed together.
    """
    n = len(parent)
    score = np.add.reduceat(weights[places], np.concatenate([[0], ends[:-1]])) if n else np.zeros(0)
    node = np.stack([np.zeros(n), score], 1)
    edge = weights[N_FEATURES:].reshape(N_EDGES, 2, 2)[kinds]  # parent's label, child's label
    order, starts = by_depth(depth)
    levels = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    up, belief = np.zeros((n, 2)), node.copy()  # belief: own potential and all messages from below
    for at in reversed(levels[1:]):
        message = np.logaddexp.reduce(edge[at] + belief[at][:, None, :], axis=2)
        message -= message.max(axis=1, keepdims=True)
        up[at] = message
        np.add.at(belief, parent[at], message)
    joint = np.zeros((n, 2, 2))
    for at in levels[1:]:
        above = belief[parent[at]] - up[at]  # what the parent believes without this child
        both = above[:, :, None] + edge[at] + belief[at][:, None, :]
        joint[at] = both
        down = np.logaddexp.reduce(above[:, :, None] + edge[at], axis=1)
        belief[at] += down - down.max(axis=1, keepdims=True)
    norm = np.logaddexp.reduce(belief, axis=1)
    p = np.exp(belief[:, 1] - norm) if n else np.zeros(0)
    inner = parent >= 0
    joint[inner] = np.exp(joint[inner] - np.logaddexp.reduce(joint[inner].reshape(-1, 4), axis=1)[:, None, None])
    joint[~inner] = 0
    return p, joint


def _forests(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Forest]]:
    """Batches with their parsed pages; a batch is cut so that a forest has some BATCH_CHARS of html, or one page."""
    for whole in batches:
        start, size = 0, 0
        lengths = [len(x) if x else 0 for x in whole.column(column).to_pylist()]
        for k, chars in enumerate([*lengths, BATCH_CHARS + 1]):
            if k > start and size + chars > BATCH_CHARS or k == len(lengths):
                part = whole.slice(start, k - start)
                if len(part):
                    forest = Forest()
                    for i, html in enumerate(part.column(column).to_pylist()):
                        forest.page(i, html or "")
                    yield part, forest
                start, size = k, 0
            size += chars


def labelled_pages(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """html with data-main marks: layouts filled with the words of at most sample pages, those of the least hashes."""
    chosen = pages.select(F.col(f"`{html}`").cast("string").alias("html")).where("length(html) > 0").orderBy(F.xxhash64("html")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .html_layouts import layouts

        for b in batches:
            made = [x for html in b.column(0).to_pylist() for x in layouts(html)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["html"])

    return chosen.repartition(8).mapInArrow(run, "html string")


def train(labelled: DataFrame, html: str = "html", steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the model, of N_FEATURES + 4 * N_EDGES, from pages with data-main marks (a bounded sample)."""
    kinds = ["parent", "depth", "kinds", "label", "places", "ends"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, forest in _forests(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in forest.arrays()], names=kinds)

    parsed = materialize(labelled.select(F.col(f"`{html}`").cast("string").alias("html")).mapInArrow(parse, ", ".join(f"{k} array<long>" for k in kinds)), "parsed")
    spark: SparkSession = labelled.sparkSession
    size = N_FEATURES + 4 * N_EDGES
    weights, moved = np.zeros(size), np.zeros(size)
    for _ in range(steps):
        now = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(size), 0
            for b in batches:
                for row in range(b.num_rows):
                    parent, depth, kind, label, places, ends = (np.asarray(c[row].values) for c in b.columns)
                    p, joint = marginals(now.value, parent, depth, kind, places, ends)
                    widths = np.diff(np.concatenate([[0], ends]))
                    total[:N_FEATURES] += np.bincount(places, np.repeat(label - p, widths), N_FEATURES)
                    inner = np.flatnonzero(parent >= 0)
                    cell = kind[inner] * 4 + label[parent[inner]] * 2 + label[inner]
                    total[N_FEATURES:] += np.bincount(cell, minlength=4 * N_EDGES)
                    expected = np.zeros((N_EDGES, 4))
                    np.add.at(expected, kind[inner], joint[inner].reshape(-1, 4))
                    total[N_FEATURES:] -= expected.ravel()
                    count += len(parent)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([count], pa.int64())], names=["g", "n"])

        parts = parsed.mapInArrow(gradient, "g array<double>, n long").collect()  # a row a task
        n = sum(r["n"] for r in parts)
        if not n:
            break
        step = np.sum([r["g"] for r in parts], axis=0) / n - ridge * weights
        moved += step * step
        weights = weights + rate * step / np.sqrt(moved + 1e-12)
        now.unpersist()
    return weights


def extract(pages: DataFrame, weights: np.ndarray, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (page_id, url by default), text and n_chars of each page."""
    keys = keep or ["page_id", "url"]
    rows = pages.select(*(F.col(f"`{c}`") for c in keys), F.col(f"`{html}`").cast("string").alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, forest in _forests(batches, len(keys)):
            parent, depth, kinds, _, places, ends = forest.arrays()
            p, _ = marginals(shared.value, parent, depth, kinds, places, ends)
            texts: list[list[str]] = [[] for _ in range(len(b))]
            for page, element, said in forest.blocks:
                if p[element] > 0.5:
                    texts[page].append(said)
            out = ["\n\n".join(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*(f"k{i}" for i in range(len(keys))), "text", "n_chars"])

    plain = rows.toDF(*(f"k{i}" for i in range(len(keys))), "__html")
    schema = ", ".join([*(f"k{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keys))), "text string", "n_chars long"])
    return plain.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keys)), "text", "n_chars")
