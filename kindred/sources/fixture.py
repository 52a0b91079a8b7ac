"""Entities, truth and splits over the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import token_sets


def _words(first: int, n: int):
    return F.array_join(F.slice(F.split("text", " "), first, n), " ")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, source, business_name, business_address, country): words 1-4 name, 5-12 and a code address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = (1 + F.col("doc_id") % 3).cast("int")
    return docs.select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        source.alias("source"),
        _words(1, 4).alias("business_name"),
        F.concat(_words(5, 8), F.lit(" "), (10000 + F.col("n_chars")).cast("string")).alias("business_address"),
        F.upper("lang").alias("country"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities moved into shared buildings (doc_id modulo 101) of a few countries (modulo 5), by their own
    names: for operators on equal addresses, or on equal names in other countries."""
    number = F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("long")
    return entities(spark, sf_dir).withColumns({"business_address": F.concat(F.lit("Building "), (number % 101).cast("string"), F.lit(", North Wing")), "country": F.concat(F.lit("C"), (number % 5).cast("string"))})


#: Two documents are one entity from this share of common tokens on, in per cent of all tokens of either.
TRUE_PERCENT = 90


def truth(spark: SparkSession, sf_dir: str, percent: int = TRUE_PERCENT) -> DataFrame:
    """``alike`` of the documents of a folder, made once a session: every evaluation joins with it, some many times."""
    key = spark.sparkContext.applicationId, sf_dir, percent
    if key not in _made:
        _made[key] = alike(spark, sf_dir, percent)
    return _made[key].select("*")


_made: dict[tuple[str, str, int], DataFrame] = {}


def alike(spark: SparkSession, sf_dir: str, percent: int) -> DataFrame:
    """(s1_id, cand_id): documents of source 1 and of the others whose whole normalised texts are alike.

    Alike is a Jaccard similarity of token sets of ``percent`` or more; texts
    without tokens are like nothing (see ``token_sets.alike``).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the tokens of normalize(text), in one pass over it
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9]+", " "))
    found = token_sets.alike(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("own"), text.alias("text")), percent)
    name = lambda c: F.concat(F.lit("S"), (1 + F.col(c) % 3).cast("string"), F.lit("-"), F.col(c).cast("string"))
    return found.select(name("own_id").alias("s1_id"), name("other_id").alias("cand_id"))
