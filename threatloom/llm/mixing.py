"""Temperature mixing of sources (DataFrame functions only).

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected until the
weights' entropy meets a target, and raised where a source would be repeated more than ``max_epochs`` times. Weights
become token budgets, and budgets become block permutations: a source's documents lie in hash blocks, every epoch
permutes the blocks anew and takes whole blocks until the budget is used up; the last block is taken in part, in the
order of a hash. A source has ``blocks`` blocks, and twice as many as long as they would hold more than ``block_tokens``
tokens on average.

By default the budget is the least one at which every source is read whole at least once, so nothing is left out.

Texts are read twice: to count tokens, which are written by source and hash, and to be given out. Only (source, block) token
sums are shuffled; no source is sorted or summed in one task, and texts stay where they are.

Documents are placed by a hash of id and text. Only equal rows share it; where a budget ends among equal rows, those are numbered
(by ranges, in several tasks) and as many are taken as fit, so equal or null ids don't blur a budget.

Cases: a null or empty text has no words and counts one token; a null source is a source; a null id is carried along;
repeated rows share their blocks, and each row's copies are its own; an empty table gives no rows; further columns are carried along, those with a result's name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, sized_broadcast

#: Target entropy as a share of the largest possible (all sources alike), and how often a source may be read.
TARGET_ENTROPY = 0.97
MAX_EPOCHS = 2.0
BLOCKS, BLOCK_TOKENS = 64, 1 << 22
#: Exponents tried at once; each round narrows the bracket by this factor.
GRID = 64
ROUNDS = 5
BROADCAST_ROWS = 20_000
RESULTS = ("n_tokens", "weight", "epoch", "block", "copy")


def tokens(text: Column) -> Column:
    """Words of a text, 1 at least (long)."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS) -> float:
    """Exponent in [0, 1] for sources (source, tokens).

    The largest exponent whose weights still have the target entropy (a share of the largest possible); if sources would
    then be read more than max_epochs times as often as the least read, the least exponent that keeps that limit.
    Each round tries GRID exponents in one aggregation, so the driver gets GRID numbers whatever the number of sources.
    """
    stats = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    total, n = stats[0], stats[1]
    if not total or n < 2:
        return 1.0
    lo, hi = 0.0, 1.0  # the target is met at lo; entropy falls as the exponent grows
    want = target_entropy * math.log(n)
    share = F.log(F.col("tokens") / F.lit(float(total)))
    for _ in range(ROUNDS):
        tries = [lo + (hi - lo) * k / GRID for k in range(1, GRID + 1)]
        rows = (
            sources.select(share.alias("s"), F.explode(F.array(*map(F.lit, tries))).alias("a"))
            .groupBy("a")
            .agg(F.sum(F.exp(F.col("a") * F.col("s"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("s")) * F.col("a") * F.col("s")).alias("e"))
            .select("a", (F.log("z") - F.col("e") / F.col("z")).alias("h"))
            .collect()
        )
        met = [r["a"] for r in rows if r["h"] >= want]
        best = max(met, default=lo)
        lo, hi = best, min(1.0, best + (hi - lo) / GRID)
    ratio = math.log(stats[3] / stats[2])  # epochs of the smallest source over those of the largest: ratio * (1 - exponent)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio * (1 - mid) <= math.log(max_epochs) else (mid, high)
    return max(lo, high)


def budgets(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """sources (source, tokens) plus weight and budget (tokens to take).

    budget: tokens in all; by default the least at which each source's own is all its tokens or more.
    """
    powered = sources.withColumn("p", F.pow(F.col("tokens").cast("double"), F.lit(exponent)))
    sums = powered.agg(F.sum("p").alias("z"), F.max(F.col("tokens") / F.col("p")).alias("r"))
    per_p = F.col("r") if budget is None else F.lit(float(budget)) / F.col("z")
    rows = powered.crossJoin(F.broadcast(sums)).withColumn("epochs", F.col("p") * per_p / F.col("tokens"))  # one row
    # sums of doubles differ in their last digits from run to run: whole epochs are made whole, other budgets have 3 decimals
    whole = F.abs(F.col("epochs") - F.round("epochs")) < 1e-6
    exact = F.when(whole, F.round("epochs") * F.col("tokens")).otherwise(F.round(F.col("epochs") * F.col("tokens"), 3))
    return rows.select("source", "tokens", (F.col("p") / F.col("z")).alias("weight"), F.greatest(exact, F.lit(0.0)).alias("budget"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: float | None = None,
    blocks: int = BLOCKS,
    block_tokens: int = BLOCK_TOKENS,
    with_results: bool = True,
) -> DataFrame:
    """A row for each copy of each document in the mixture: docs' columns plus n_tokens, weight (of the source), epoch
    (from 0), block (its place in the epoch's permutation) and copy (from 0).

    A source's copies hold its budget of tokens, exceeded by less than one document. with_results=False: docs' columns alone,
    whatever their names.
    """
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that no result and no helper column has
    back = {p: c for c, p in plain.items() if not with_results or c.lower() not in RESULTS}
    keep = list(back)
    rows = docs.toDF(*plain.values()).select(
        *keep,
        tokens(F.col(plain[text])).alias("n_tokens"),
        F.coalesce(F.concat(F.lit("s:"), F.col(plain[source]).cast("string")), F.lit("null")).alias("__source"),
        F.xxhash64(F.col(plain[doc_id]), F.col(plain[text]), F.lit("mix")).alias("__h"),
    )
    sizes = materialize(rows.select("__source", "__h", "n_tokens"), "mix-sizes")
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("tokens") / float(blocks * block_tokens))))
    sources = sizes.groupBy(F.col("__source").alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    sources = materialize(sources.withColumn("n_blocks", (F.lit(blocks) * F.pow(F.lit(2.0), doublings)).cast("long")), "mix-sources")
    several = sized_broadcast(sources.select(F.col("source").alias("__source"), "n_blocks"), BROADCAST_ROWS)
    parted = lambda df: df.join(several, "__source").withColumn("__part", F.pmod("__h", "n_blocks")).drop("n_blocks")
    small, rows = parted(sizes), parted(rows)
    sums = materialize(small.groupBy(F.col("__source").alias("source"), F.col("__part").alias("part")).agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    exponent = find_exponent(sources, target_entropy, max_epochs)
    plan = budgets(sources, exponent, budget)
    # every epoch of a source: its budget in tokens, then the place and the tokens before each block
    epochs = plan.select(
        "source", "weight", "tokens", "budget", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1, F.lit(0)))).alias("epoch")
    ).select("source", "weight", "epoch", F.least(F.col("tokens").cast("double"), F.col("budget") - F.col("epoch") * F.col("tokens")).alias("left"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "epoch", "part"), "part")
    placed = (
        sums.join(epochs, "source")
        .withColumns({"block": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        .where(F.col("before") < F.col("left"))
        .withColumn("room", F.when(F.col("before") + F.col("tokens") > F.col("left"), F.col("left") - F.col("before")))
    )
    placed = materialize(placed.select(F.col("source").alias("__source"), F.col("part").alias("__part"), "weight", "epoch", "block", "room"), "mix-plan")
    # blocks taken in part: documents in hash order while the tokens before them leave room
    parts = placed.where(F.col("room").isNotNull()).select("__source", "__part", "epoch", "room")
    inside = Window.partitionBy("__source", "__part", "epoch").orderBy("__h")
    cut = (
        small.join(sized_broadcast(parts, BROADCAST_ROWS), ["__source", "__part"])
        .groupBy("__source", "__part", "epoch", "room", "__h")
        .agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("m"))
        .withColumn("before", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < F.col("room"))
        .withColumn("take", F.least(F.col("m"), F.ceil((F.col("room") - F.col("before")) * F.col("m") / F.col("n"))))
        .groupBy("__source", "__part", "epoch")
        .agg(F.max(F.struct("__h", "take", "m")).alias("last"))
    )
    cut = materialize(cut.select("__source", "__part", "epoch", F.col("last.__h").alias("last"), F.col("last.take").alias("take"), F.col("last.m").alias("m")), "mix-cut")
    whole = (
        placed.join(cut, ["__source", "__part", "epoch"], "left")
        .groupBy("__source", "__part")
        .agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("epoch", "block", "last", "take"))).alias("__epochs"))
    )
    whole = sized_broadcast(materialize(whole, "mix-epochs"), BROADCAST_ROWS)
    # equal rows that a budget takes in part are numbered
    split = cut.where(F.col("take") < F.col("m")).select("__source", F.col("last").alias("__h")).distinct()
    if split.isEmpty():
        rows = rows.withColumn("__nth", F.lit(0))
    else:
        split = sized_broadcast(materialize(split, "mix-split"), BROADCAST_ROWS)
        equal = rows.join(split, ["__source", "__h"], "left_semi").withColumn("__group", F.concat("__source", F.lit("|"), F.col("__h").cast("string")))
        equal = numbered(equal, "__group", []).drop("__group", "__total")
        rows = rows.join(split, ["__source", "__h"], "left_anti").withColumn("__nth", F.lit(0).cast("long")).unionByName(equal)
    taken = F.filter("__epochs", lambda e: e["last"].isNull() | (F.col("__h") < e["last"]) | ((F.col("__h") == e["last"]) & (F.col("__nth") < e["take"])))
    out = rows.join(whole, ["__source", "__part"]).select(*keep, "n_tokens", "weight", F.posexplode(taken).alias("copy", "__e"))
    results = ["n_tokens", F.round("weight", 9).alias("weight"), F.col("__e.epoch").alias("epoch"), F.col("__e.block").alias("block"), "copy"]
    return out.select(*(F.col(p).alias(c) for p, c in back.items()), *(results if with_results else []))
