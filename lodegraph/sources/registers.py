"""Company registers as CSV files: nodes by kind and their relationships, as tables to expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of each domain, and the relation that each label of a relationship belongs to.
FILES = (("entity", "nodes-entities.csv"), ("officer", "nodes-officers.csv"), ("intermediary", "nodes-intermediaries.csv"), ("address", "nodes-addresses.csv"), ("other", "nodes-others.csv"))
RELATION_OF = {
    "officer_of": 0, "intermediary_of": 1, "registered_address": 2, "same_name_as": 3, "same_as": 3, "same_id_as": 3, "probably_same_officer_as": 3, "same_intermediary_as": 3, "same_address_as": 3,
    "similar": 4, "similar_company_as": 4, "same_company_as": 4, "connected_to": 5, "underlying": 5,
}
UNSAID = ("node_id", "internal_id", "ibcRUC", "country_codes", "valid_until", "note")
LINKS = 6


def relation(label: Column) -> Column:
    """The relation of a label; null for labels that none has."""
    pairs = [x for k, v in RELATION_OF.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), label)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line breaks; all columns are text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(entities, adj)``: ``id``, ``domain``, ``text``, ``country``, and ``id``, ``rel``, ``pos``, ``nbr`` in both directions.

    A text is the domain, the non-empty columns, and up to six distinct labels of relationships each way, first seen first.
    Rows without a number as id, repeated ids, and relationships of unknown ends or labels are left out.
    """
    entities = None
    for d, (name, file) in enumerate(FILES):
        df = read_csv(spark, f"{folder}/{file}").withColumn("_at", F.monotonically_increasing_id())
        said = [c for c in df.columns if c not in UNSAID and c != "_at"]
        parts = [F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""), F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`")))) for c in said]
        text = F.trim(F.concat(F.lit(name + " "), F.concat_ws("; ", *parts)))
        country = F.nullif(F.col("country_codes"), F.lit("")) if name == "officer" and "country_codes" in df.columns else F.lit(None).cast("string")
        part = df.select(F.expr("try_cast(node_id as bigint)").alias("id"), F.lit(d).alias("domain"), text.alias("text"), country.alias("country"), "_at").filter("id is not null")
        entities = part if entities is None else entities.union(part)
    once = entities.groupBy("id").agg(F.min(F.struct("domain", "_at", "text", "country")).alias("e")).select("id", "e.domain", "e.text", "e.country")
    rel = read_csv(spark, f"{folder}/relationships.csv")
    _, _, kind, label = (F.col(f"`{c}`") for c in rel.columns[:4])
    r = rel.select(
        F.expr(f"try_cast(`{rel.columns[0]}` as bigint)").alias("a"), F.expr(f"try_cast(`{rel.columns[1]}` as bigint)").alias("b"), relation(kind).alias("rel"),
        F.lower(F.trim(F.coalesce(label, F.lit("")))).alias("label"), F.monotonically_increasing_id().alias("at")).filter("a <> b and rel is not null")
    ids = once.select("id")
    r = r.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")

    def labels(column: str, head: str, name: str) -> DataFrame:
        first = r.filter("label <> ''").groupBy(F.col(column).alias("id"), "label").agg(F.min("at").alias("at"))
        six = first.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]), 1, LINKS).alias("ls"))
        return six.select("id", F.concat(F.lit(f"; {head}: "), F.concat_ws(", ", "ls")).alias(name))

    full = once.join(labels("a", "links", "_out"), "id", "left").join(labels("b", "linked by", "_in"), "id", "left")
    full = full.select("id", "domain", F.concat("text", F.coalesce("_out", F.lit("")), F.coalesce("_in", F.lit(""))).alias("text"), "country")
    both = r.select(F.col("a").alias("id"), "rel", F.col("b").alias("nbr")).union(r.select("b", "rel", "a")).distinct()
    from pyspark.sql import Window

    adj = both.withColumn("pos", F.row_number().over(Window.partitionBy("id", "rel").orderBy("nbr")) - 1)
    return full, adj.select("id", F.col("rel").cast("tinyint").alias("rel"), F.col("pos").cast("int").alias("pos"), "nbr")
