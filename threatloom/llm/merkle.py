"""Merkle manifest of a dataset: one tree per group, one over the groups, and a proof for each row.

Rows are numbered in order by ranges (a global sort, a count per range, offsets), so no group is sorted in one task, and cut
into aligned blocks of ``fanout ** local`` leaves. A task hashes a block to its root. Then blocks acquire the upper tree by
butterfly exchange: in round r the blocks whose numbers differ in digit r alone (base fanout) swap the roots of the subtrees
they stand in; each of them hashes the common ancestor redundantly and notes its siblings. After the last round every block
has the root of its tree and its whole upper proof, without a pass downwards. A last subtree with fewer blocks than its siblings
sends its root from each block to all places that lack a partner, so a round moves at most twice as many rows as there are
blocks, and a group holds at most ``fanout`` of them. The roots of the groups are leaves of one more tree, by the same function.

Proofs are rows of (left, right): the concatenated digests of the siblings before and after, level by level.

Cases: nulls are encoded as ``-``, so they differ from empty texts; a null group is a group, the first; rows of equal ids are
ordered by their digests, equal rows by an arbitrary number (their digests are equal, so any order gives the same root); one row is
its own root and its proof is empty; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

FANOUT = 8
#: Levels inside a block: 8 ** 4 leaves are hashed by one task at a time.
LOCAL = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PROOF = "array<struct<left: string, right: string>>"


def _digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def encoded(column: Column) -> Column:
    """A field as a tree hashes it: ``-`` for null, else its UTF-8 bytes' count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def _levels(digests: list[str], n_levels: int | None, fanout: int) -> list[list[str]]:
    """Digests of each level, from the leaves to the root (n_levels: up to there, even of one node)."""
    levels = [digests]
    while len(levels[-1]) > 1 if n_levels is None else len(levels) <= n_levels:
        row = levels[-1]
        levels.append([_digest("".join(row[k : k + fanout])) for k in range(0, len(row), fanout)])
    return levels


def _block_levels(leaves: list[str], size: int, fanout: int, local: int) -> list[list[str]]:
    return _levels(leaves, None if size <= fanout**local else local, fanout)


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """blocks (tree, block, n_blocks, root) with root, that of the tree, and proof, the block's siblings up to it."""
    state = blocks.withColumn("proof", F.array().cast(_PROOF))
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    width = 1  # blocks below a node of this round
    while width < most:
        own = F.floor(F.col("block") / width)  # the node of this round that the block stands in
        spare = F.least(F.lit(width), F.col("n_blocks") - own * width)  # blocks of that node
        place = F.col("block") % width
        # the places of this node: its own, and those that its missing blocks would have
        places = F.when(spare == width, F.array(place)).otherwise(F.sequence(place, F.lit(width - 1).cast("long"), spare))
        sent = state.where(F.col("n_blocks") > width).select("tree", F.floor(own / fanout).alias("parent"), F.explode(places).alias("place"), own.alias("node"), (F.col("block") % width).alias("at"), "root", "block", "n_blocks", "proof")
        met = sent.groupBy("tree", "parent", "place").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("nodes"), F.collect_list(F.when(F.col("at") == F.col("place"), F.struct("node", "block", "n_blocks", "proof"))).alias("blocks"))
        one = met.select("tree", "nodes", F.explode("blocks").alias("b")).select("tree", "nodes", "b.*")
        side = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["root"]), "")
        moved = one.select(
            "tree", "block", "n_blocks",
            F.sha2(F.array_join(F.transform("nodes", lambda x: x["root"]), ""), 256).alias("root"),
            F.concat("proof", F.array(F.struct(side(lambda x: x["node"] < F.col("node")).alias("left"), side(lambda x: x["node"] > F.col("node")).alias("right")))).alias("proof"),
        )
        state = materialize(moved.unionByName(state.where(F.col("n_blocks") <= width).select(moved.columns)), "butterfly")
        width *= fanout
    return state


def trees(leaves: DataFrame, order: list[str], fanout: int = FANOUT, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """leaves (tree, digest, ...) as a table with block, at (place in the block) and size (of the tree), and blocks (tree, block, root, proof)."""
    per_block = fanout**local
    rows = numbered(leaves, "tree", order)
    rows = rows.withColumns({"block": F.floor(F.col("__nth") / per_block), "at": (F.col("__nth") % per_block).cast("int")}).withColumnRenamed("__total", "size")
    rows = materialize(rows.drop("__nth"), "leaves")

    def root(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        size = int(part["size"].iloc[0])
        top = _block_levels(part["digest"].tolist(), size, fanout, local)[-1][0]
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "block": part["block"].iloc[:1], "n_blocks": [-(-size // per_block)], "root": [top]})

    found = rows.select("tree", "block", "at", "size", "digest").groupBy("tree", "block").applyInPandas(root, "tree string, block long, n_blocks long, root string")
    return rows, butterfly(materialize(found, "blocks"), fanout)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", text: str = "text", tampered: Column | None = None, fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """order (the id), leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    tampered: rows whose text is folded with A-Z lower-cased, to show that a changed row isn't verified; none by default.
    """
    ids = docs.schema[order].dataType
    cols = [F.col(f"`{c}`") for c in fields]
    changed = leaf([F.translate(c.cast("string"), _UPPER, _UPPER.lower()) if f == text else c for f, c in zip(fields, cols, strict=True)])
    fresh = leaf(cols)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),  # null before all others
        F.col(f"`{order}`").alias("id"),
        fresh.alias("digest"),
        (fresh if tampered is None else F.when(tampered, changed).otherwise(fresh)).alias("now"),
    )
    rows, blocks = trees(leaves, ["id", "digest"], fanout, local)
    # one more tree, of the groups' roots
    tops = blocks.where("block = 0").select(F.lit("all").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"))
    top_rows, top_blocks = trees(tops, ["id"], fanout, local)

    def proofs(key: tuple, part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        return _prove(part, top, fanout, local)

    top_proofs = top_rows.groupBy("tree", "block").cogroup(top_blocks.select("tree", "block", "root", "proof").groupBy("tree", "block"))
    top_proofs = materialize(top_proofs.applyInPandas(lambda key, a, b: _top_proofs(a, b, fanout, local), f"tree string, top_root string, top_proof {_PROOF}"), "tops")
    uppers = blocks.select("tree", "block", F.col("root").alias("subroot"), "proof").join(top_proofs, "tree")
    uppers = uppers.select("tree", "block", "subroot", F.col("top_root").alias("root"), F.concat("proof", "top_proof").alias("proof"))
    both = rows.groupBy("tree", "block").cogroup(materialize(uppers, "uppers").groupBy("tree", "block"))
    schema = f"id {ids.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = both.applyInPandas(proofs, schema)
    return out.select(F.col("id").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _siblings(levels: list[list[str]], at: int, fanout: int) -> Iterator[tuple[str, str]]:
    """(left, right) of a leaf's runs, level by level."""
    for row in levels[:-1]:
        first = at - at % fanout
        yield "".join(row[first:at]), "".join(row[at + 1 : first + fanout])
        at //= fanout


def _top_proofs(part: pd.DataFrame, top: pd.DataFrame, fanout: int, local: int) -> pd.DataFrame:
    part = part.sort_values("at")
    levels = _block_levels(part["digest"].tolist(), int(part["size"].iloc[0]), fanout, local)
    upper = list(top["proof"].iloc[0])
    proofs = [[*({"left": a, "right": b} for a, b in _siblings(levels, k, fanout)), *upper] for k in range(len(part))]
    return pd.DataFrame({"tree": part["id"].tolist(), "top_root": top["root"].iloc[0], "top_proof": proofs})


def _prove(part: pd.DataFrame, top: pd.DataFrame, fanout: int, local: int) -> pd.DataFrame:
    """Proof and folded root of each leaf of a block."""
    part = part.sort_values("at")
    levels = _block_levels(part["digest"].tolist(), int(part["size"].iloc[0]), fanout, local)
    upper = [(p["left"], p["right"]) for p in top["proof"].iloc[0]]
    joined = "".join(a + b for a, b in upper)
    rows = []
    for k, (digest, now) in enumerate(zip(part["digest"], part["now"], strict=True)):
        own = list(_siblings(levels, k, fanout))
        folded = now
        for left, right in own + upper:
            folded = _digest(left + folded + right)
        rows.append((digest, _digest("".join(a + b for a, b in own) + joined), folded))
    out = pd.DataFrame(rows, columns=["leaf", "proof_sha256", "folded_root"])
    return pd.DataFrame({"id": part["id"].array, "leaf": out["leaf"], "subroot": top["subroot"].iloc[0], "root": top["root"].iloc[0], "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"]})


def _oracle(levels: int = 7) -> str:
    """SQL of the query: levels of at most 8 ** levels rows a language."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hashed = lambda text: "sha256(" + " || ".join([*map(value, FIELDS[:-1]), value(text)]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [unicode(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"

    def tower(p: str, source: str, key: str) -> str:
        """CTEs of all levels over source (key, i, h), and of what lies left and right of each node in its run."""
        parts = [f"{p}0 AS (SELECT {key} AS k, i, h, count(*) OVER (PARTITION BY {key}) AS n FROM {source})"]
        for d in range(levels):
            parts.append(
                f"{p}{d + 1} AS (SELECT k, i, CASE WHEN n = 1 THEN h0 ELSE sha256(s) END AS h, count(*) OVER (PARTITION BY k) AS n FROM "
                f"(SELECT k, i // 8 AS i, min(n) AS n, min(h) AS h0, string_agg(h, '' ORDER BY i) AS s FROM {p}{d} GROUP BY k, i // 8))"
            )
            parts.append(
                f"{p}s{d} AS (SELECT k, i, coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n FROM {p}{d} WINDOW w AS (PARTITION BY k, i // 8 ORDER BY i))"
            )
        return ", ".join(parts)

    docs, tops = tower("d", "leaves", "lang"), tower("t", "tops", "0")
    steps, last = [], "f0"
    for name, alias, key in [("d", "i", "lang"), ("t", "ti", "0")]:
        for d in range(levels):
            nxt = f"f{len(steps) + 1}"
            steps.append(
                f"{nxt} AS (SELECT {last}.* EXCLUDE (proof, fold), proof || CASE WHEN s.n = 1 THEN '' ELSE s.l || s.r END AS proof, CASE WHEN s.n = 1 THEN fold ELSE sha256(s.l || fold || s.r) END AS fold "
                f"FROM {last} JOIN {name}s{d} s ON s.k IS NOT DISTINCT FROM {key} AND s.i = {last}.{alias} // {8**d})"
            )
            last = nxt
    return f"""
WITH leaves AS (SELECT doc_id, lang, {hashed('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS now,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM documents),
{docs},
tops AS (SELECT k AS lang, h, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 AS i FROM d{levels}),
{tops},
f0 AS (SELECT leaves.*, tops.i AS ti, tops.h AS subroot, '' AS proof, now AS fold FROM leaves JOIN tops ON leaves.lang IS NOT DISTINCT FROM tops.lang),
{', '.join(steps)}
SELECT doc_id, {last}.h AS leaf, subroot, t{levels}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t{levels}.h AS verified FROM {last}, t{levels}
"""


ORACLE_SQL = _oracle()
