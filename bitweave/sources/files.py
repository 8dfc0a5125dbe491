"""Triples, stores, routes, edges and vocabularies from and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_triples(spark: SparkSession, path: str, most_length: int | None = None) -> DataFrame:
    """(path, pos, s, r, o, valid) of JSON files, each an array of triples. A triple is valid if it
    has three parts, none longer than ``most_length``; see ``check_triples``."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<array<string>>").alias("ts"))
    t = text.select("path", F.posexplode("ts").alias("pos", "t"))
    fits = F.lit(True) if most_length is None else ~F.exists("t", lambda x: F.length(x) >= most_length)
    return t.select("path", "pos", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")], ((F.size("t") == 3) & fits).alias("valid"))


def check_triples(triples: DataFrame) -> DataFrame:
    """The valid triples; ValueError names the number of bad ones and the first of them."""
    bad = triples.where("not valid").agg(F.count("*").alias("n"), F.min(F.struct("path", "pos")).alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} entries are no triples, the first at position {bad['first']['pos']} of {bad['first']['path']}")
    return triples.where("valid").drop("valid")


def append_facts(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of facts; columns are matched by name."""
    return facts.unionByName(more, allowMissingColumns=True)


def save_store(entries: DataFrame, path: str) -> None:
    """Entries as Parquet: keys, payloads and meta data are columns of one table."""
    entries.write.mode("overwrite").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_edges(edges: DataFrame, path: str) -> None:
    """Edges as JSON lines."""
    edges.write.mode("overwrite").json(path)


def load_edges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Edges of JSON lines, with the hot ones marked again: heat is derived, not stored."""
    from bitweave.operators.edges import is_hot

    return spark.read.schema(schema).json(path).withColumn("hot", is_hot(F.col("support"), F.col("confidence")))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON file {"token": id, ...}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    return text.select(F.explode("m").alias("token", "id"))


def write_stories(stories: DataFrame, text: str, path: str) -> None:
    """Texts as lines with a line --- after each."""
    stories.select(F.concat(F.col(text), F.lit("\n---"))).write.mode("overwrite").text(path)


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """Texts that lines of --- part."""
    return spark.read.text(path, lineSep="\n---\n").where("value <> ''").select(F.col("value").alias("text"))
