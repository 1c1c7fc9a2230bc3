"""Dictionaries and knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.upsert import upsert

TECHNIQUE = r"^(T\d{4}(?:\.\d{3})?)(?:\s|$)"


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON arrays, one file a category (its stem): name, category, weight, source; see keep_last."""
    rows = spark.read.schema("name string, weight int, source string").option("multiLine", True).json(path)
    rows = rows.withColumns({"category": F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1), "row_no": F.monotonically_increasing_id()})
    return keep_last(rows)


def keep_last(rows: DataFrame) -> DataFrame:
    """A4: rows with a name and a weight, the last (row_no) of each (name, category)."""
    good = rows.where((F.trim(F.coalesce("name", F.lit(""))) != "") & F.col("weight").isNotNull())
    last = good.groupBy("name", "category").agg(F.max_by(F.struct("weight", "source"), "row_no").alias("r"))
    return last.select("name", "category", "r.weight", "r.source")


def read_galaxy(spark: SparkSession, path: str, category: str) -> DataFrame:
    """A galaxy document's values, see galaxy_rows."""
    schema = "values array<struct<value:string,uuid:string,description:string,meta:struct<synonyms:array<string>,refs:array<string>,country:string>>>"
    return galaxy_rows(spark.read.schema(schema).option("multiLine", True).json(path), category)


def galaxy_rows(docs: DataFrame, category: str) -> DataFrame:
    """One row for each named element of ``values``: name, category, weight 50, source misp, synonyms."""
    rows = docs.select(F.explode("values").alias("v")).where("v.value IS NOT NULL AND trim(v.value) <> ''")
    return rows.select(F.trim("v.value").alias("name"), F.lit(category).alias("category"), F.lit(50).alias("weight"), F.lit("misp").alias("source"), F.coalesce("v.meta.synonyms", F.array().cast("array<string>")).alias("synonyms"), F.col("v.description").alias("description"))


BUNDLE = (
    "objects array<struct<type:string,id:string,name:string,description:string,revoked:boolean,external_references:array<struct<source_name:string,external_id:string,url:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_platforms:array<string>,x_mitre_data_sources:array<string>,x_mitre_detection:string,x_mitre_is_subtechnique:boolean>>"
)


def read_attack_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The bundle's techniques, see technique_rows."""
    return technique_rows(spark.read.schema(BUNDLE).option("multiLine", True).json(path))


def technique_rows(docs: DataFrame) -> DataFrame:
    """Attack patterns that aren't revoked, by their framework id (the last of a repeated id wins), with phases,
    platforms, data sources, detection, subtechnique flag and other references."""
    rows = docs.select(F.posexplode("objects").alias("pos", "o")).where("o.type = 'attack-pattern' AND NOT coalesce(o.revoked, false)")
    own = F.filter("o.external_references", lambda x: x["source_name"] == "mitre-attack")
    rows = rows.withColumn("technique_id", F.get(own, F.lit(0))["external_id"]).where("technique_id IS NOT NULL")
    last = rows.groupBy("technique_id").agg(F.max_by("o", "pos").alias("o"))
    none = F.array().cast("array<string>")
    return last.select(
        "technique_id",
        F.col("o.name").alias("name"),
        F.col("o.description").alias("description"),
        F.coalesce(F.transform(F.filter("o.kill_chain_phases", lambda x: x["kill_chain_name"] == "mitre-attack"), lambda x: x["phase_name"]), none).alias("phases"),
        F.coalesce("o.x_mitre_platforms", none).alias("platforms"),
        F.coalesce("o.x_mitre_data_sources", none).alias("data_sources"),
        F.coalesce("o.x_mitre_detection", F.lit("")).alias("detection"),
        F.coalesce("o.x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
        F.coalesce(F.transform(F.filter("o.external_references", lambda x: ~x["source_name"].eqNullSafe(F.lit("mitre-attack"))), lambda x: x["url"]), none).alias("other_refs"),
    )


def _id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), TECHNIQUE, 1), F.lit(""))


def with_technique_id(df: DataFrame) -> DataFrame:
    """technique_id from the value, else from the name."""
    return df.withColumn("technique_id", F.coalesce(_id(F.col("value")), _id(F.col("name"))))


def new_techniques(bundle: DataFrame, galaxy: DataFrame) -> DataFrame:
    """Bundle techniques that the galaxy knows neither by id nor by lower-case name."""
    known = with_technique_id(galaxy)
    by_id = bundle.join(known.where("technique_id IS NOT NULL").select("technique_id").distinct(), "technique_id", "left_anti")
    names = known.select(F.lower("name").alias("__n")).where("__n IS NOT NULL").distinct()
    return by_id.join(names, F.lower(by_id["name"]) == F.col("__n"), "left_anti")


#: What a technique gets from the bundle where the galaxy has none; of the first two, an empty one counts as none.
FILLED = ("description", "platforms", "phases", "data_sources", "detection")


def merge_techniques(galaxy: DataFrame, bundle: DataFrame) -> DataFrame:
    """Galaxy rows, matched by value id, then name id, then lower-case name; description, platforms, phases, data sources and
    detection filled where absent.

    Each match is a join against one row a key, so no galaxy row is repeated.
    """
    fields = F.struct(*FILLED)
    ids = bundle.groupBy("technique_id").agg(F.max_by(fields, "article_id" if "article_id" in bundle.columns else "technique_id").alias("__b"))
    names = bundle.groupBy(F.lower("name").alias("__n")).agg(F.max_by(fields, "technique_id").alias("__c")).where("__n IS NOT NULL")
    rows = galaxy.withColumns({"__v": _id(F.col("value")), "__m": _id(F.col("name")), "__l": F.lower("name")})
    rows = rows.join(ids.withColumnsRenamed({"technique_id": "__v", "__b": "__b1"}), "__v", "left").join(ids.withColumnsRenamed({"technique_id": "__m", "__b": "__b2"}), "__m", "left")
    rows = rows.join(names.withColumnRenamed("__n", "__l"), "__l", "left").withColumn("__x", F.coalesce("__b1", "__b2", "__c"))
    own = {c: F.nullif(F.col(c), F.lit("")) if c in FILLED[:2] else F.col(c) for c in FILLED}
    return rows.select(*(c for c in galaxy.columns if c not in FILLED), *(F.coalesce(own[c], F.col(f"__x.{c}")).alias(c) for c in FILLED), F.col("__x").isNotNull().alias("merged"))


def upsert_knowledge(dictionary: DataFrame, rows: DataFrame) -> DataFrame:
    """E5: insert or overwrite all that rows have beside the key (document, weight, source) by (name, category)."""
    return upsert(dictionary, rows, ["name", "category"], "overwrite")


def rank_within(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
