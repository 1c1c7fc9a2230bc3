"""N-gram Jaccard join by a MinHash LSH forest.

Texts are sets of ``SHINGLE``-word shingles (whitespace words; a shorter text is one shingle). Texts with equal sets
are one node. A node has a label of ``max_depth`` MinHash values (16 bits each) in each of ``trees`` tries. A trie is
its labels sorted; only labels whose first ``min_depth`` values another node has are kept.

Matching starts with whole labels and shortens the prefixes a value at a time. In each round the nodes of a prefix are
matched with the least of them, its center; whole signatures estimate the similarity s of these pairs, and each pair
found at or above the threshold stands for 1 / (1 - (1 - s^depth)^trees) pairs. Prefixes are shortened
until the pairs found are ``target_recall`` of the pairs so estimated, or ``min_depth`` is reached. So near copies that
differ little need deep prefixes only, and those at the threshold get short ones.

Nodes that share a prefix are the group of its center. Groups of one center are verified together and exactly: in blocks of
``block`` nodes against each other, where counts of common shingles come from a blocked matrix product. A group wider than
a block sends no texts to its block pairs: a node is there what its set has and lacks of the center's (a bit for each of the
center's shingles, and the hashes of its others), packed once a group. A block pair
returns one row a node (its number of links, and the least node it reaches), so no pair is ever a row. A pair of nodes
with several centers in common is counted in the group of the least, and a group all of whose nodes have a lesser center in
common isn't verified at all. Only verified links make classes.

Result: one row per document with its class (the least id of all documents it is linked with, directly or through
others) and its number of links (other documents of similarity ``THRESHOLD`` or more, copies included).

Cases: a null text, or one without words, links to nothing and is a class of its own; repeated rows are copies; rows
whose id is null are linked like others, and a class of such rows alone has a null class; an empty table gives no rows;
further columns are dropped. Sets are compared by 128-bit hashes, shingles within a text pair by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import groups, join_groups, likely, materialize, mix64, sized_broadcast, word_hashes

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TREES = 20
MAX_DEPTH, MIN_DEPTH = 8, 4
TARGET_RECALL = 0.9999
BLOCK = 512
BROADCAST_ROWS = 100_000
#: Characters of the texts of wide groups' centers up to which they are broadcast; shingles of centers that a task keeps.
BROADCAST_CHARS, KEPT_SHINGLES = 32 << 20, 4 << 20
_M = np.uint64(0x9DDFEA08EB382D69)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ids, starts = word_hashes(texts)
    rolled = ids.copy()
    for k in range(1, size):
        rolled = rolled[: max(0, len(ids) - k)] * _M + ids[k:]
    rolled = mix64(rolled)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            h = np.uint64(b - a)
            for x in ids[a:b]:
                h = np.uint64((int(h) * int(_M) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            yield mix64(np.array([h]))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function over the shingles."""
    out, high = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), 512):
        np.minimum(out, (high[k : k + 512, None] * a + b).min(axis=0), out=out)
    return (mix64(out.astype(np.uint64)) >> np.uint64(48)).astype(">u2")


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        sums = [mix64(shingles * _M + np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(shingles)) for k in (0, 0xC2B2AE3D27D4EB4F)]
    return tuple(int(x) for x in mix64(np.array(sums)).view(np.int64))


def _row(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), _row(doc_id, text).alias("row"))


def _signed(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """rows (doc_id, text, row) -> doc_id, row, h1, h2 (hashes of the set, null without words), labels (of all trees in a row)."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                hashes, labels = [], []
                for s in shingle_sets(part.column(1)):
                    hashes.append(set_hash(s) if len(s) else (None, None))
                    labels.append(signature(s, a, b).tobytes() if len(s) else None)
                cols = [part.column(0), part.column(2), *(pa.array([h[k] for h in hashes], pa.int64()) for k in range(2)), pa.array(labels, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "h1", "h2", "labels"])

    return rows.mapInArrow(run, "doc_id long, row long, h1 long, h2 long, labels binary")


def _prefix(depth: int) -> Column:
    return F.xxhash64("tree", F.substring("label", 1, 2 * depth))


def _forest(nodes: DataFrame, trees: int, max_depth: int, min_depth: int) -> DataFrame:
    """The tries, sorted: tree, label, id of the labels whose first min_depth values some other node has."""
    size = 2 * max_depth
    leaves = nodes.select("id", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("id", "tree", F.expr(f"substring(labels, {size} * tree + 1, {size})").alias("label"))
    leaves = leaves.withColumn("stem", _prefix(min_depth))
    stems = materialize(leaves.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "stems")
    found = join_groups(likely(leaves, stems, "stem"), stems, ["stem"]).select("tree", "label", "id")
    return materialize(found.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"), "forest")


def _centers(forest: DataFrame, depth: int) -> DataFrame:
    """Distinct (id, center) of nodes that share a prefix of the depth with a lesser node, its center."""
    keyed = forest.select(_prefix(depth).alias("key"), "id")
    least = materialize(keyed.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")
    return materialize(join_groups(keyed, least, ["key"]).where("id <> center").select("id", "center").distinct(), "centers")


def found_share(similarity: Column, depth: int, trees: int) -> Column:
    """Chance that two nodes of the similarity share a prefix of the depth in a tree or more."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(depth))), F.lit(float(trees)))


def estimated_recall(pairs: DataFrame, labelled: DataFrame, depth: int, trees: int, threshold: float) -> float:
    """Share of the pairs at the threshold or above that pairs (id, center), found at the depth, hold by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in b.columns) if b.num_rows else (np.zeros((0, 1)),) * 2
            yield pa.RecordBatch.from_arrays([pa.array((x == y).mean(axis=1))], names=["s"])

    other = labelled.select(F.col("id").alias("center"), F.col("labels").alias("other"))
    alike = pairs.join(labelled, "id").join(other, "center").select("labels", "other").mapInArrow(run, "s double").where(F.col("s") >= threshold)
    found = alike.agg(F.count(F.lit(1)).alias("n"), F.sum(1 / found_share(F.col("s"), depth, trees)).alias("all")).first()
    return found["n"] / found["all"] if found["n"] else 0.0


def matched(nodes: DataFrame, trees: int, max_depth: int, min_depth: int, threshold: float, target_recall: float) -> tuple[DataFrame, int]:
    """(id, center) at the depth that meets the target recall, and the depth."""
    forest = _forest(nodes, trees, max_depth, min_depth)
    labelled = materialize(nodes.select("id", "labels").join(forest.select("id").distinct(), "id"), "labelled")
    depth = max_depth
    while True:
        pairs = _centers(forest, depth)
        if depth <= min_depth or estimated_recall(pairs, labelled, depth, trees, threshold) >= target_recall:
            return pairs, depth
        depth -= 1


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) numbers of common shingles."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[column] > 1
    owner, column, width = owner[use], shared[column[use]], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float64)
    for begin in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [begin, begin + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[lo:hi], column[lo:hi] - begin] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def _local_least(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Least node of each one's component in a boolean adjacency."""
    label = nodes.copy()
    while True:
        best = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, best)
        if (new == label).all():
            return label
        label = new


def _covered(mine: list[list[int]], center: int) -> np.ndarray:
    """Which pairs of nodes have a center in common that is less than center; mine: the nodes' centers."""
    lesser = [[c for c in m if c < center] for m in mine]
    place = {c: k for k, c in enumerate({c for m in lesser for c in m})}
    member = np.zeros((len(mine), len(place)), np.float32)
    for i, m in enumerate(lesser):
        member[i, [place[c] for c in m]] = 1
    return member @ member.T > 0


def _text_sets(found: list[tuple]) -> list[np.ndarray | None]:
    """The sets of (h1, h2, text); None where another row bears the hash of the node's."""
    sets = (next(shingle_sets(pa.array([text], pa.string()))) for _, _, text in found)
    return [s if len(s) and set_hash(s) == (h1, h2) else None for (h1, h2, _), s in zip(found, sets, strict=True)]


def _by_text(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of (h1, h2, text), 0 where it isn't the node's, and their numbers of common shingles."""
    sets = [np.zeros(0, np.uint64) if s is None else s for s in _text_sets(found)]
    return np.array([len(s) for s in sets]), common_counts(sets)


def _by_delta(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and numbers of common shingles of (bits, extra), all packed against one center."""
    extras = [np.frombuffer(extra, np.uint64) for _, extra in found]
    packed = np.stack([np.frombuffer(bits, np.uint8) for bits, _ in found])
    both = common_counts(extras)
    for k in range(0, packed.shape[1], 512):
        dense = np.unpackbits(packed[:, k : k + 512], axis=1).astype(np.float32)
        both += np.rint(dense @ dense.T).astype(np.int64)
    return np.bitwise_count(packed).sum(axis=1, dtype=np.int64) + np.array([len(e) for e in extras]), both


def _packed(wide: DataFrame, base: DataFrame) -> DataFrame:
    """wide (center, n_blocks, block, id, n_docs, mine, h1, h2, text) with base (center, base: its text) -> bits and extra for the text.

    Any text serves as base, as long as a center has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, kept = {}, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                *plain, h1, h2, text, base = part.columns
                use, bits, extra, last, mine = [], [], [], None, None
                for k, found in enumerate(zip(plain[0].to_pylist(), plain[3].to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True)):
                    center, *node = found
                    if node != last:
                        last, mine = node, _text_sets([(*node[1:], text[k].as_py())])[0]
                    if mine is None:
                        continue
                    if center not in centers:
                        if kept > KEPT_SHINGLES:
                            centers, kept = {}, 0
                        centers[center] = next(shingle_sets(pa.array([base[k].as_py()], pa.string())))
                        kept += len(centers[center])
                    among = np.isin(mine, centers[center], assume_unique=True)
                    use.append(k)
                    bits.append(np.packbits(np.isin(centers[center], mine[among], assume_unique=True)).tobytes())
                    extra.append(mine[~among].tobytes())
                take = pa.array(use, pa.int64())
                cols = [*(c.take(take) for c in plain), pa.array(bits, pa.binary()), pa.array(extra, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["center", "n_blocks", "block", "id", "n_docs", "mine", "bits", "extra"])

    rows = wide.join(base, "center").select("center", "n_blocks", "block", "id", "n_docs", "mine", "h1", "h2", "text", "base")
    return rows.mapInArrow(run, "center long, n_blocks int, block int, id long, n_docs long, mine array<long>, bits binary, extra binary")


def _verify(members: DataFrame, threshold: Fraction, content: list[str]) -> DataFrame:
    """members (center, i, j, block, id, n_docs, mine, and h1, h2, text or bits, extra: content) -> id, least (node reached), links (documents).

    Rows of a block pair come together; a pair holds at most about 2 x BLOCK nodes whatever the group's size.
    """
    num, den = threshold.numerator, threshold.denominator
    compare = _by_text if "text" in content else _by_delta
    rows = members.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def flush():
            cols = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["id", "least", "links"])

        for (center, i, j), found in groups(batches, 3):
            found = list({(r[1], r[-1]): r for r in found}.values())  # repeated rows of a text are one node
            blocks = np.array([r[0] for r in found])
            todo = ~_covered([r[3] for r in found], center)
            np.fill_diagonal(todo, False)
            if i != j:
                todo &= blocks[:, None] != blocks[None, :]
            use = np.flatnonzero(todo.any(axis=1))
            if len(use) < 2:
                continue
            ids, weights = (np.array([found[k][c] for k in use], np.int64) for c in (1, 2))
            sizes, both = compare([found[k][4:] for k in use])
            linked = (den * both >= num * (sizes[:, None] + sizes[None, :] - both)) & todo[np.ix_(use, use)] & (sizes[:, None] * sizes[None, :] > 0)
            links = (linked * weights[None, :]).sum(axis=1)
            least = _local_least(linked, ids)
            out.extend((int(a), int(b), int(c)) for a, b, c in zip(ids, least, links, strict=True) if c)
            if len(out) >= 4096:
                yield flush()
        yield flush()

    return rows.select("center", "i", "j", "block", "id", "n_docs", "mine", *content).mapInArrow(run, "id long, least long, links long")


def _texts_of(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """placed with the texts of its rows (text_row); a row that repeats comes as often, one without an id once."""
    placed = sized_broadcast(placed, BROADCAST_ROWS)
    named, others = (texts.where(c).join(placed, F.col("row") == F.col("text_row")) for c in (F.col("doc_id").isNotNull(), F.col("doc_id").isNull()))
    return named.unionByName(others.dropDuplicates(["row", "id", "center"]))


def _links(texts: DataFrame, placed: DataFrame, threshold: Fraction) -> DataFrame:
    """id, least and links of the nodes placed (a written table), verified by texts in groups of a block, else by deltas."""
    zero = F.lit(0)
    plain = _texts_of(texts, placed.where("n_blocks = 1")).withColumns({"i": zero, "j": zero})
    verified = _verify(plain, threshold, ["h1", "h2", "text"])
    wide = placed.where("n_blocks > 1")
    if wide.isEmpty():
        return verified
    bases = wide.where("id = center").select("center", F.col("text_row").alias("r"))
    bases = texts.join(sized_broadcast(bases, BROADCAST_ROWS), F.col("row") == F.col("r")).select("center", F.col("text").alias("base"))
    bases = materialize(bases.dropDuplicates(["center"]), "bases")
    if bases.agg(F.sum(F.length("base"))).first()[0] <= BROADCAST_CHARS:
        bases = F.broadcast(bases)
    packed = _packed(_texts_of(texts, wide), bases).withColumn("o", F.explode(F.sequence(zero, F.col("n_blocks") - 1)))
    packed = packed.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    return verified.unionByName(_verify(packed, threshold, ["bits", "extra"]))


def _members(pairs: DataFrame, block: int) -> DataFrame:
    """id, mine (all its centers, itself where it is one), center, n_blocks, block, for groups that no lesser one covers."""
    own = pairs.unionByName(pairs.select(F.col("center").alias("id"), "center").distinct())
    mine = materialize(own.groupBy("id").agg(F.collect_list("center").alias("mine")), "mine")  # a center a tree at most, and itself
    placed = mine.select("id", "mine", F.explode("mine").alias("center"))
    sizes = materialize(placed.groupBy("center").agg(F.count(F.lit(1)).alias("n")), "sizes")
    both = placed.select("center", F.explode(F.filter("mine", lambda c: c < F.col("center"))).alias("lesser"))
    both = both.groupBy("center", "lesser").agg(F.count(F.lit(1)).alias("both"))
    within = materialize(both.join(sizes, "center").where("both = n").select(F.col("center").alias("c")).distinct(), "within")
    left = materialize(sizes.join(within, F.col("center") == F.col("c"), "left_anti"), "groups")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    return join_groups(placed, left, ["center"]).select("id", "mine", "center", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"))


def _classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: Fraction = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    min_depth: int = MIN_DEPTH,
    target_recall: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, row (hash of id and text), label (least node of the class), class_id and n_links of each document."""
    texts = _rows(docs, doc_id, text)
    signed = materialize(_signed(texts, trees, max_depth), "signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("text_row")
    nodes = signed.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), one, F.count(F.lit(1)).alias("n_docs"), F.first("labels").alias("labels"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    pairs, _ = matched(nodes, trees, max_depth, min_depth, float(threshold), target_recall)
    placed = _members(pairs, block).join(nodes.select("id", "h1", "h2", "text_row", "n_docs"), "id")
    verified = materialize(_links(texts, materialize(placed, "members"), threshold), "verified")
    labels = components(verified.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "id")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    joined = nodes.select("id", "h1", "h2", "rep", "n_docs").join(links, "id", "left").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    joined = materialize(joined, "joined")
    classes = materialize(joined.groupBy("label").agg(F.min("rep").alias("class_id")).select(F.col("label").alias("l"), "class_id"), "classes")
    result = joined.join(classes, F.col("label") == F.col("l")).select(
        "h1", "h2", "label", "class_id", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.col("n_docs").alias("n")
    )
    result = materialize(result, "result")
    rows = signed.select("doc_id", "row", "h1", "h2")
    alone = rows.where("h1 is null").select("doc_id", "row", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return join_groups(rows.where("h1 is not null"), result, ["h1", "h2"]).select("doc_id", "row", "label", "class_id", "n_links").unionByName(alone)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc id, class_id and n_links of each document (see the module's text); options as of the forest's parameters."""
    return _classes(docs, doc_id, text, **options).select(F.col("doc_id").alias(doc_id), "class_id", "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class left: the one of the least id (of equal ids, of the least hash of id and text).

    Texts are filtered where they are read as long as the rejected rows are few enough to broadcast.
    """
    rows = materialize(_classes(docs, doc_id, text, **options).where("label is not null").select("doc_id", "row", "label"), "classes")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("one"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1").select("label", "n", F.col("one.row").alias("kept")), "first")
    grouped = join_groups(rows.select("row", "label"), first, ["label"]).groupBy("row", "kept").agg(F.count(F.lit(1)).alias("n"))
    grouped = materialize(grouped, "grouped")
    gone = grouped.where("row <> kept or n > 1").select(F.col("row").alias("r"))
    twice = grouped.where("row = kept and n > 1").select(F.col("row").alias("r"))
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that no helper column has
    keyed = docs.toDF(*plain.values()).withColumn("__row", _row(plain[doc_id], plain[text]))
    rest = keyed.join(sized_broadcast(gone, BROADCAST_ROWS), F.col("__row") == F.col("r"), "left_anti")
    once = keyed.join(sized_broadcast(twice, BROADCAST_ROWS), F.col("__row") == F.col("r"), "left_semi").dropDuplicates(["__row"])
    return rest.unionByName(once).select(*(F.col(p).alias(c) for c, p in plain.items()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT d.doc_id, min(root) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM documents d JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
