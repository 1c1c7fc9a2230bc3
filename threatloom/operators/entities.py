"""Entity extraction, validation and the dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources.shared import sized_broadcast

#: Rows of a phrase table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_PHRASES = 100_000
TOKEN = r"[\p{L}\p{N}_]+"
#: What a text with a match of the pattern has, by pattern: cheaper to look for than the pattern.
SIGNS = {
    "cve": r"[cC][vV][eE]-\d", "file_hash_md5": r"[a-fA-F0-9]{32}", "file_hash_sha1": r"[a-fA-F0-9]{40}", "file_hash_sha256": r"[a-fA-F0-9]{64}", "ip_address": r"\d\.\d",
    "domain": r"[a-zA-Z0-9-]\.[a-zA-Z]{2}", "bitcoin_address": r"[13][a-zA-Z0-9]{25}", "ethereum_address": r"0[xX][a-fA-F0-9]{40}", "windows_file_path": r"[A-Za-z]:\\",
    "unix_file_path": "/", "registry_key": "\\", "email": "@",
}


def full_text(title: str = "title", content: str = "content") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def extract_patterns(articles: DataFrame, patterns: list[tuple] = R.PATTERNS) -> DataFrame:
    """article_id, name, category, confidence of each match of each pattern; one pass, one explode.

    A pattern runs over a text only if the text has what each of its matches holds (SIGNS).
    """
    text = F.col("__t")

    def hits(rank: int, name: str, pattern: str, category: str, confidence: float) -> Column:
        tagged = lambda m: F.struct(m.alias("name"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        sign = SIGNS.get(name)
        test = text.contains(sign) if sign in ("@", "/", "\\") else text.rlike(sign) if sign else F.lit(True)
        return F.transform(F.when(test, found).otherwise(F.array().cast("array<string>")), tagged)

    found = [hits(k, n, p, c, w) for k, (n, p, c, w) in enumerate(patterns)]
    return articles.select("article_id", full_text().alias("__t")).select("article_id", F.explode(F.concat(*found)).alias("m")).select("article_id", "m.*")


def _in_networks(ip: Column, networks: list[str]) -> Column:
    tests = []
    for net in networks:
        base, bits = net.split("/")
        first = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
        tests.append(ip.between(first, first + (1 << (32 - int(bits))) - 1))
    return reduce(lambda a, b: a | b, tests)


def ip_number(name: Column) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one (leading zeros aren't allowed)."""
    part = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    value = F.aggregate(F.split(name, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when(name.rlike(rf"^{part}(?:\.{part}){{3}}$"), value)


def outside(name: Column, networks: list[str]) -> Column:
    """Whether a name is an IPv4 address outside the networks; the number is computed once."""
    return F.exists(F.array(ip_number(name)), lambda ip: ip.isNotNull() & ~_in_networks(ip, networks))


def valid_cve(n: Column) -> Column:
    """The shape, and a year from 1999 to 2030."""
    return n.rlike(r"(?i)^CVE-\d{4}-\d{4,}$") & F.regexp_extract(n, r"-(\d{4})-", 1).try_cast("int").between(1999, 2030)


def valid_ip(n: Column, networks: list[str] = R.ENTITY_NETWORKS) -> Column:
    """IPv4 outside the reserved networks and the known literals."""
    return F.coalesce(outside(n, networks) & ~n.isin(R.KNOWN_IPS), F.lit(False))


def valid_domain(n: Column) -> Column:
    """C4: 4 to 253 characters, not a well-known domain, a suffix of two letters or more, a label that is no number or single letter."""
    label = F.regexp_extract(F.lower(n), r"([a-z0-9-]+)\.[a-z]{2,}$", 1)
    return F.length(n).between(4, 253) & ~F.lower(n).isin(R.KNOWN_DOMAINS) & ~n.rlike(r"^\d+\.\d+\.\d+$") & (F.length(label) > 1) & ~label.rlike(r"^\d+$")


def valid_domains(hits: DataFrame, suffixes: DataFrame, most: int = BROADCAST_PHRASES) -> DataFrame:
    """C4 with a table of public suffixes (suffix): hits (name) that are domains whose longest suffix of up to three labels is in
    the table, behind a label that is no number or single letter. The table is broadcast up to ``most`` rows."""
    labels = F.split(F.lower(F.trim("name")), r"\.")
    rows = hits.withColumn("__id", F.xxhash64("name")).where(F.length(F.trim("name")).between(4, 253) & ~F.lower(F.trim("name")).isin(R.KNOWN_DOMAINS))
    tails = rows.select("name", "__id", labels.alias("l")).distinct().select("name", "__id", "l", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where("n <= size(l)")
    tails = tails.withColumn("suffix", F.array_join(F.slice("l", -F.col("n"), F.col("n")), "."))
    known = tails.join(sized_broadcast(suffixes.select(F.lower("suffix").alias("suffix")).distinct(), most), "suffix")
    label = known.groupBy("name").agg(F.max_by(F.get("l", F.size("l") - F.col("n") - 1), "n").alias("label"))
    good = label.where((F.length("label") > 1) & ~F.col("label").rlike(r"^\d+$")).select("name")
    return rows.drop("__id").join(good, "name", "left_semi").select(hits.columns)


def valid_hash(n: Column) -> Column:
    """32, 40 or 64 hexadecimal digits, not all alike."""
    return n.rlike(r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$") & (F.replace(F.lower(n), F.substring(F.lower(n), 1, 1), F.lit("")) != "")


def valid_mail(n: Column) -> Column:
    return n.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$") & ~F.lower(n).isin(R.KNOWN_MAILS)


def valid_path(n: Column) -> Column:
    return F.length(n).between(3, 500) & ((n.rlike(r"^[A-Za-z]:\\") & ~n.rlike('[<>"|?*]')) | (n.startswith("/") & ~n.contains("\0")))


def valid_registry(n: Column) -> Column:
    return (F.length(n) <= 500) & F.upper(n).rlike("^(?:" + "|".join(R.HIVES) + ")") & n.contains("\\")


def valid_other(n: Column) -> Column:
    return F.length(n).between(2, 500) & n.rlike("[a-zA-Z0-9]")


def valid_entity(name: str = "name", category: str = "category") -> Column:
    """Whether a trimmed name is valid for its category."""
    n, c = F.trim(F.coalesce(F.col(name), F.lit(""))), F.col(category)
    tests = {"cve": valid_cve, "ip_address": valid_ip, "domain": valid_domain, "file_hash": valid_hash, "email": valid_mail, "file_path": valid_path, "registry_key": valid_registry}
    out = valid_other(n)
    for k, test in tests.items():
        out = F.when(c == k, test(n)).otherwise(out)
    return (n != "") & F.coalesce(out, F.lit(False))


def valid_entities(hits: DataFrame) -> DataFrame:
    return hits.where(valid_entity())


def drop_code_context(df: DataFrame, text: str = "content") -> DataFrame:
    """The text without code fences, code and pre tags, example and demo sections."""
    return df.withColumn(text, F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)" + "|".join(R.CODE_SPANS), " "))


def phrases(dictionary: DataFrame) -> DataFrame:
    """entity_id, phrase (lower), rank (0: the name, then its synonyms) and its number of tokens."""
    names = F.concat(F.array("name"), F.coalesce(F.filter(F.split("synonyms", r"\|"), lambda x: (x != "") & (x != F.col("name"))), F.array().cast("array<string>")))
    rows = dictionary.select("entity_id", F.posexplode(names).alias("rank", "matched"))
    return rows.select("entity_id", "rank", "matched", F.lower("matched").alias("phrase"), F.size(F.regexp_extract_all(F.lower("matched"), F.lit(TOKEN), F.lit(0))).alias("n_tokens"))


def match_dictionary(articles: DataFrame, dictionary: DataFrame, most: int = BROADCAST_PHRASES) -> DataFrame:
    """article_id, entity_id, name, category, weight, matched: one hit for each article and entity, by its first name or
    synonym that occurs as whole words in any case.

    Phrases are keyed by their first token. Up to ``most`` of them are broadcast: a text's distinct tokens meet the first tokens,
    and a phrase of several tokens is tested where its first one was found, in the text's own row, so neither the longest
    phrase nor a long text makes more rows and no text is shuffled. A larger table is joined by a shuffle of (article, token), and
    texts by article after that.
    """
    token = F.regexp_extract_all("phrase", F.lit(TOKEN), F.lit(0))
    plain = (F.col("n_tokens") == 1) & (F.col("phrase") == token[0])
    table = phrases(dictionary).where("n_tokens > 0").select("entity_id", "rank", "matched", "phrase", token[0].alias("__first"), F.concat(F.lit(" "), F.array_join(token, " "), F.lit(" ")).alias("__run"), plain.alias("__plain"))
    texts = articles.select("article_id", F.lower(full_text()).alias("__t")).withColumn("__w", F.regexp_extract_all("__t", F.lit(TOKEN), F.lit(0)))
    texts = texts.withColumn("__r", F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")))
    # the tokens follow each other, and the phrase's own signs lie between them
    inside = F.col("__t").contains(F.col("phrase")) & F.col("__r").contains(F.col("__run"))
    if table.limit(most + 1).count() <= most:
        found = texts.select("article_id", "__t", "__r", F.explode(F.array_distinct("__w")).alias("__first")).join(F.broadcast(table), "__first").where(F.col("__plain") | inside)
        names = F.broadcast(dictionary.select("entity_id", "name", "category", "weight"))
    else:
        near = texts.select("article_id", F.explode(F.array_distinct("__w")).alias("__first")).join(table, "__first")
        more = near.where("NOT __plain").join(texts.select("article_id", "__t", "__r"), "article_id").where(inside)
        found, names = near.where("__plain").unionByName(more.select(near.columns)), dictionary.select("entity_id", "name", "category", "weight")
    first = found.groupBy("article_id", "entity_id").agg(F.min_by("matched", "rank").alias("matched"))
    return first.join(names, "entity_id").select("article_id", "entity_id", "name", "category", "weight", "matched")


def boost_confidence(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Confidence plus .05 in a title plus .03 for each further occurrence (.1 at most), 1 at most; position."""
    a = articles.select("article_id", F.lower(F.coalesce("title", F.lit(""))).alias("__h"), F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))).alias("__x"))
    low = F.lower("name")
    times = (F.length("__x") - F.length(F.replace(F.col("__x"), low, F.lit("")))) / F.length(low)
    head = F.col("__h").contains(low)
    more = F.when(times > 1, F.least(0.03 * (times - 1), F.lit(0.1))).otherwise(0.0)
    rows = hits.join(a, "article_id")
    return rows.withColumns(
        {"confidence": F.round(F.least(F.lit(1.0), F.col("confidence") + F.when(head, 0.05).otherwise(0.0) + more), 6), "position": F.when(head, "title").otherwise("content")}
    ).drop("__h", "__x")


def dedup_entities(hits: DataFrame) -> DataFrame:
    """The first hit of each (article, lower name, category): pattern hits before dictionary hits, then by rank."""
    w = Window.partitionBy("article_id", F.lower("name"), "category").orderBy(F.when(F.col("method") == "regex", 0).otherwise(1), "rank", "name")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pack_entities(hits: DataFrame) -> DataFrame:
    """C11: per article the entities (sorted), their number and categories."""
    return hits.groupBy("article_id").agg(
        F.sort_array(F.collect_list(F.struct("category", "name", "confidence"))).alias("entities"), F.count(F.lit(1)).alias("entity_count"), F.sort_array(F.collect_set("category")).alias("categories")
    )


def discover_entities(hits: DataFrame, dictionary: DataFrame, source: str = "dynamic") -> DataFrame:
    """(name, category) of hits that the dictionary lacks, with the category's weight and a capped name."""
    weight = F.lit(R.DEFAULT_WEIGHT)
    for c, w in R.NEW_WEIGHTS.items():
        weight = F.when(F.col("category") == c, w).otherwise(weight)
    fresh = hits.select(cap_name(F.col("name"), F.col("category")).alias("name"), "category").distinct()
    return fresh.join(dictionary.select("name", "category"), ["name", "category"], "left_anti").withColumns({"weight": weight, "source": F.lit(source)})


def cap_name(name: Column, category: Column, most: int = 500) -> Column:
    """Names over the limit keep their tail (paths, registry keys) or head."""
    tail = F.concat(F.lit("..."), F.right(name, F.lit(most - 3)))
    head = F.concat(F.left(name, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(name) <= most, name).when(category.isin("file_path", "registry_key"), tail).otherwise(head)


def synonym_table(dictionary: DataFrame) -> DataFrame:
    """C14: entity_id, synonym, synonym_lower: every synonym and primary name."""
    return phrases(dictionary).select("entity_id", F.col("matched").alias("synonym"), F.col("phrase").alias("synonym_lower")).distinct()


def extraction_stats(hits: DataFrame) -> DataFrame:
    """Entities and articles per category and in all (null category)."""
    return hits.rollup("category").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("article_id").alias("articles"))


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """Entries by (source, category), by source and in all."""
    return dictionary.rollup("source", "category").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("max_weight"))


def latest_entries(dictionary: DataFrame, k: int = 10) -> DataFrame:
    """The k entries with the largest ids."""
    return dictionary.orderBy(F.desc("entity_id")).limit(k)
