"""Pair attributes, features, scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions.text import number_match, strip_legal

from . import blocking

# The features in the order that models and outputs have them.
FEATURES_11 = ["name_ratio", "name_token_sort", "name_token_set", "clean_name_ratio", "address_ratio", "address_token_sort", "address_token_set", "number_match_score", "country_match", "name_length_diff", "address_length_diff"]
FEATURES_9 = [f for f in FEATURES_11 if f not in ("clean_name_ratio", "number_match_score")]
#: A fixed logistic scorer, expressible in SQL: weight by feature, and the bias.
LOGIT = {"name_ratio": 3.0, "name_token_sort": 1.0, "name_token_set": 2.0, "clean_name_ratio": 2.0, "address_ratio": 3.0, "address_token_sort": 1.0, "address_token_set": 2.0, "number_match_score": 1.0, "country_match": 0.5, "name_length_diff": -0.05, "address_length_diff": -0.02}
BIAS = -8.0
FLOOR, THRESHOLD = 0.45, 0.9


def attributes(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Both sides' normalised fields; same country and a candidate with a name only. Unknown ids drop."""
    side = lambda p, key: norm.select(F.col("entity_id").alias(key), F.col("name_norm").alias(f"{p}_name"), F.col("addr_norm").alias(f"{p}_addr"), F.col("country_norm").alias(f"{p}_country"))
    both = pairs.join(side("s1", "s1_id"), "s1_id").join(side("c", "cand_id").filter("c_name <> ''"), "cand_id")
    return both.filter("s1_country = c_country").select("s1_id", "cand_id", "s1_name", "s1_addr", "s1_country", "c_name", "c_addr", "c_country")


#: The columns of normalised entities that a pair has of both sides.
SIDES = {"name_norm": "name", "addr_norm": "addr", "country_norm": "country"}


def met(norm: DataFrame, truth: DataFrame | None = None, **limits) -> DataFrame:
    """``attributes`` of the candidates, made where they meet (``blocking.met``) so that no pairs are moved; with ``truth``, is_true."""
    both = blocking.met(norm, truth, SIDES, **limits).filter("new AND c_name <> '' AND s1_country = c_country")
    return both.drop("place", "new")


def features(pairs: DataFrame, columns=FEATURES_11) -> DataFrame:
    """Adds the features asked for, in order."""
    n, m, a, b = (F.col(c) for c in ("s1_name", "c_name", "s1_addr", "c_addr"))
    blank_ok = "clean_name_ratio" not in columns  # the older set lets blank countries match
    same = (F.col("s1_country") == F.col("c_country")) & (F.lit(blank_ok) | (F.col("s1_country") != ""))
    alike = {
        "name_ratio": ("ratio", n, m), "name_token_sort": ("token_sort", n, m), "name_token_set": ("token_set", n, m),
        "clean_name_ratio": ("ratio", strip_legal(n), strip_legal(m)),
        "address_ratio": ("ratio", a, b), "address_token_sort": ("token_sort", a, b), "address_token_set": ("token_set", a, b),
    }
    made = {
        "number_match_score": number_match(a, b), "country_match": F.when(same, 1).otherwise(0),
        "name_length_diff": F.abs(F.length(n) - F.length(m)), "address_length_diff": F.abs(F.length(a) - F.length(b)),
    }
    wanted = {c: alike[c] for c in columns if c in alike}
    out = pairs.withColumn("_alike", sim.similarities(wanted)) if wanted else pairs
    return out.withColumns({c: F.col("_alike")[c] if c in wanted else made[c] for c in columns}).drop("_alike")


def score_logit(df: DataFrame, weights=LOGIT, bias: float = BIAS) -> DataFrame:
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + F.col(name) * w
    return df.withColumn("prob", 1.0 / (1.0 + F.exp(-z)))


def disambiguated(df: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Drops blank candidate names, number conflicts, and pairs whose names are far apart by both measures."""
    return df.filter((F.col("c_name") != "") & (F.col("number_match_score") != -1) & ((F.col("clean_name_ratio") >= floor) | (F.col("name_token_set") >= floor)))


def source_of(col):
    return F.split_part(col, F.lit("-"), F.lit(1))


def at_least(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return df.filter(F.col("prob") >= threshold)


def top_per_source(df: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each target source for each entity, ties by candidate id."""
    order = W.partitionBy("s1_id", "target").orderBy(F.col("prob").desc(), "cand_id")
    return df.withColumn("target", source_of(F.col("cand_id"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def match_output(norm: DataFrame, capped: DataFrame) -> DataFrame:
    """One row per source-1 entity: its S2 matches, then its S3 matches, best first; '' when none."""
    order = F.array_sort(F.collect_list(F.struct("target", "rank", "cand_id")))
    lists = capped.filter(F.col("target").isin("S2", "S3")).groupBy("s1_id").agg(F.array_join(F.transform(order, lambda x: x["cand_id"]), ",").alias("matched_entity_ids"))
    own = norm.filter("source = 1").select(F.col("entity_id").alias("source1_entity_id"))
    return own.join(lists, own["source1_entity_id"] == lists["s1_id"], "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))
