"""Sharding by a hierarchical weighted hash tree (law ``key``).

Regions hold racks, racks hold shards. At each level a row draws ``-ln(u) / weight`` for every child, u being a
hash of its key and the child's name; the smallest draw wins. A row's path depends on its key and the tree only.

The first ``base`` shards form the fixed tree. Every later shard enters as a region of its own with one rack, so no
draw of an old node changes: a row that the new region wins goes to the new shard, all others keep their old path.
Growth therefore moves rows only into the new shard. A changed weight re-draws the nodes above that leaf alone.

Slots are numbered without a gap inside each shard, in the order of ``buckets`` hash buckets, key, size and checksum: rows are
sorted by ranges and counted by range, so neither a shard nor a hot key is numbered in one task, whatever it holds.

Cases: a null key hashes like any value; a null text has size 1 and checksum 0; rows with equal keys share a shard
and take neighbouring slots, in the order of size and checksum; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

BASE_SHARDS = 8
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
BUCKETS = 1024


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The value whose draw is smallest; options: (draw, value)."""
    return F.array_min(F.array(*(F.struct(d.alias("d"), v.alias("v")) for d, v in options)))["v"]


def tree(shards: int, weights: list[float] | None = None, base: int = BASE_SHARDS) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight of the shards that the fixed tree holds."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(min(shards, base)):
        rack = s // SHARDS_PER_RACK
        out.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[s] = (weights or [1.0] * shards)[s]
    return out


def shard_of(key: Column, shards: int, weights: list[float] | None = None, base: int = BASE_SHARDS) -> Column:
    """Shard (int) of a key; weights: of all shards, 1 each by default."""
    w = weights or [1.0] * shards
    regions = tree(shards, w, base)
    late = range(min(shards, base), shards)

    def total(node) -> float:
        return sum(map(total, node.values())) if isinstance(node, dict) else node

    # -1 - r: descend into region r of the fixed tree; s: the region of the later shard s won
    top = _least(
        [(_draw(key, f"region/{r}", total(racks)), F.lit(-1 - r)) for r, racks in regions.items()]
        + [(_draw(key, f"late/{s}", w[s]), F.lit(s)) for s in late]
    )
    by_region = F.lit(None).cast("int")
    for r, racks in regions.items():
        rack = _least([(_draw(key, f"rack/{k}", total(leaves)), F.lit(k)) for k, leaves in racks.items()])
        inside = F.lit(None).cast("int")
        for k, leaves in racks.items():
            leaf = _least([(_draw(key, f"shard/{s}", x), F.lit(s)) for s, x in leaves.items()])
            inside = F.when(rack == k, leaf).otherwise(inside)
        by_region = F.when(top == -1 - r, inside).otherwise(by_region)
    return F.coalesce(by_region, top).cast("int")


def shard(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = BASE_SHARDS,
    weights: list[float] | None = None,
    keep_columns: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (the shard with one more shard of weight 1) of each row.

    keep_columns: carry all columns of df as well; columns of df with a result's name are then replaced.
    """
    k = F.col(f"`{key}`")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in df.columns if (c.lower() not in results if keep_columns else c == key)]
    grown = None if weights is None else [*weights, 1.0]
    bucket = F.pmod(F.xxhash64(k, F.lit("slot")), F.lit(buckets)).cast("int")
    rows = df.select(
        *(F.col(f"`{c}`") for c in keep),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, shards, weights).alias("shard"),
        shard_of(k, shards + 1, grown).alias("grown_shard"),
        bucket.alias("__bucket"),
        k.alias("__key"),
    )
    rows = numbered(rows, "shard", ["__bucket", "__key", "size", "text_crc32"])
    return rows.select(*(F.col(f"`{c}`") for c in keep), "size", "text_crc32", "law", "shard", F.col("__nth").cast("long").alias("slot"), "grown_shard")
