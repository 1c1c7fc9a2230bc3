"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit per
rule; policies are versioned bit masks that are applied afterwards, so a new policy needs no new pass over
the texts, and an ablation is a bitwise aggregation over the ledger.

Cases: a null or empty text has no words and fails ``few_words``; a null id, repeated rows and further columns
are carried along unchanged (one ledger row per input row), but columns with a result's name (in any case) are replaced by
the result; ``keep`` returns all columns as they were; an empty table gives an empty ledger.
Window equality is tested on 64-bit hashes of five consecutive word hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Bit of each rule: (name, failure test on the measurements).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("few_letters", "5 * n_letter_words < 4 * n_words"),
    ("few_stop_words", "n_stop_words < 2"),
    ("mean_line", "n_lines > 0 and word_chars < 3 * n_lines"),
]
BASE = 0b00011
#: Version -> mask of the rules that reject.
POLICIES: dict[str, int] = {"base": BASE, "v1": 0b01011, "v2": 0b11111, "v3": 0b1001111111, "english": 0b1111111111}
PRODUCTION = "v2"
#: English words of which a running text has two or more; the rule is for English policies.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_stop_words"]
RESULTS = [*MEASURES, "fail_bits", "base_failed", "policy", "kept"]


def measurements(df: DataFrame, text: str = "text") -> DataFrame:
    """df, whose columns have no measure's name, plus MEASURES (long)."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    one = df.select(
        *keep,
        F.filter(F.split(body, WORD_BREAK), lambda w: w != "").alias("__w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    two = one.select(
        *keep,
        "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\u2022]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("__w", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    h = F.col("__h")
    three = two.withColumn(
        "__g",
        F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))),
        ),
    ).drop("__h")
    g = F.col("__g")
    # only texts with some repeated window pay for the sort
    four = three.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("__g")
    s = F.col("__s")
    five = four.withColumn(
        "__p",
        F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row: its columns, the measurements and ``fail_bits`` (bit k: rule k fails)."""
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names that no result and no helper column has
    rows = measurements(df.toDF(*plain.values()), plain[text])
    own = [F.col(f"`{p}`").alias(c) for c, p in plain.items() if c.lower() not in RESULTS]
    row = F.struct(*MEASURES, total.cast("long").alias("fail_bits"))
    # a generator: a later filter on the bits isn't pushed below it, where every measurement would be computed again
    return rows.select(*plain.values(), F.explode(F.array(row)).alias("__m")).select(*own, "__m.*")


def apply_policy(rows: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """A ledger plus ``base_failed``, ``policy`` and ``kept``; a base failure always rejects."""
    bits = F.col("fail_bits")
    mask = POLICIES[version] | BASE
    return rows.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(BASE)) != 0,
            "policy": F.lit(version),
            "kept": bits.bitwiseAND(F.lit(mask)) == 0,
        }
    )


def keep(df: DataFrame, text: str = "text", version: str = PRODUCTION) -> DataFrame:
    """df's rows that the policy keeps, with all their columns as they were."""
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = apply_policy(ledger(df.toDF(*plain.values()), plain[text]), version)
    return rows.where("kept").select(*(F.col(p).alias(c) for c, p in plain.items()))


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule of it: rows the rule fails, rows only that rule rejects, rows kept without it.

    The ledger is first aggregated to one row per failure mask, so nothing but at most 2^rules counts is shuffled.
    """
    masks = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    named = [
        F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
        for v, m in (policies or POLICIES).items()
        for k, (name, _) in enumerate(RULES)
        if m >> k & 1
    ]
    bits = F.col("fail_bits")
    return (
        masks.select("fail_bits", "n", F.explode(F.array(*named)).alias("r"))
        .select("fail_bits", "n", "r.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(bits.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(bits.bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when(bits.bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""
