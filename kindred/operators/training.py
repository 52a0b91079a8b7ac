"""Splits, mined negatives, training sets and tree-ensemble models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocking import is_true, true_lists
from .evaluate import labelled
from .scoring import FEATURES_11

SEED = "42"
#: Hex digits of the md5 that a histogram of hashes has buckets for.
BUCKET_DIGITS = 4


def hashed_limit(df: DataFrame, n: int, *ids: str, seed: str = SEED) -> DataFrame:
    """A reproducible sample of n rows: those of least md5 over their ids; ``df`` itself if it has no more.

    No rows are sorted together and none go through one task: a histogram of
    the hash finds the bucket in which the n-th row lies (one job, one row to
    the driver), and rows up to that bucket are ranked within their buckets.
    """
    hashed = df.withColumn("_md5", F.md5(F.concat(*ids, F.lit(seed)))).withColumn("_bucket", F.substring("_md5", 1, BUCKET_DIGITS))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("size"))  # 16**4 rows at most
    upto = sizes.select("_bucket", "size", (F.sum("size").over(W.orderBy("_bucket")) - F.col("size")).alias("before"))
    found = upto.agg(F.sum("size").alias("all"), F.max(F.when(F.col("before") < n, F.struct("_bucket", "before"))).alias("edge")).first()
    if (found["all"] or 0) <= n:
        return df
    if found["edge"] is None:
        return df.limit(0)
    bucket, before = found["edge"]
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("_md5", *ids))
    some = hashed.filter(F.col("_bucket") <= bucket).withColumn("_place", place)
    return some.filter((F.col("_bucket") < bucket) | (F.col("_place") <= n - before)).select(df.columns)


def hash48(*ids: str, seed: str = SEED):
    """48 bits of the md5 of the ids: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(*ids, F.lit(seed))), 1, 12), 16, 10).cast("long")


def hashed_share(df: DataFrame, n: int, column: str) -> DataFrame:
    """About n rows of ``df`` by hash of a column, all of them where it has no more: one count and a filter."""
    return df.filter(hash48(column) < F.lit(float(1 << 48)) * n / df.agg(F.count("*")).scalar())


def split(s1: DataFrame, validation: int, seed: str = SEED) -> DataFrame:
    """(entity_id, split): the ``validation`` ids of least md5 are held out (see ``hashed_limit``)."""
    held = hashed_limit(s1.select("entity_id"), validation, "entity_id", seed=seed).withColumn("split", F.lit("validation"))
    return s1.select("entity_id").join(held, "entity_id", "left").na.fill("train", ["split"])


def _sides(norm: DataFrame):
    take = lambda p: [F.col(c).alias(f"{p}_{n}") for c, n in (("name_norm", "name"), ("addr_norm", "addr"), ("country_norm", "country"), ("prefix6", "prefix6"), ("first_token", "first"))]
    return norm.filter("source = 1").select(F.col("entity_id").alias("s1_id"), *take("s1")), norm.filter("source <> 1").select(F.col("entity_id").alias("cand_id"), *take("c"))


COLUMNS = ["s1_id", "cand_id", "s1_name", "s1_addr", "s1_country", "c_name", "c_addr", "c_country", "label", "pair_type"]
#: pair type: (equal columns besides the country, condition)
NEGATIVES = {
    "name_confusion": ("name", "length(s1_name) >= 5 AND s1_addr <> c_addr"),
    "prefix_confusion": ("prefix6", "length(s1_prefix6) = 6 AND s1_name <> c_name"),
    "token_confusion": ("first", "length(s1_first) >= 5 AND s1_name <> c_name"),
    "same_addr_confusion": ("addr", "length(s1_addr) >= 10 AND c_name <> '' AND s1_name <> c_name AND s1_first <> c_first"),
}


#: About how many entities and targets each kind is mined from, drawn by hash before they are joined, where a caller asks for that.
SIDES = {"name_confusion": (50_000, 300_000), "prefix_confusion": (50_000, 300_000), "token_confusion": (40_000, 250_000), "same_addr_confusion": (50_000, 300_000)}
#: Most mined negatives of each kind.
LIMITS = {"name_confusion": 35_000, "prefix_confusion": 35_000, "token_confusion": 30_000, "same_addr_confusion": 25_000}


def positives(norm: DataFrame, truth: DataFrame) -> DataFrame:
    a, b = _sides(norm)
    return truth.join(a, "s1_id").join(b, "cand_id").withColumns({"label": F.lit(1), "pair_type": F.lit("true_positive")}).select(COLUMNS)


def negatives(norm: DataFrame, truth: DataFrame, kind: str, most: int | None = None, sides: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """All pairs that look alike in one respect and are no true pair; ``most`` keeps a reproducible sample.

    With ``sides`` (as ``SIDES``) both sides are drawn before the join, so a
    frequent name, prefix or token meets a bounded number of rows; without, its
    pairs grow with the square of the rows that have it.
    """
    a, b = _sides(norm)
    if sides:
        own, targets = sides[kind]
        a, b = hashed_share(a, own, "s1_id"), hashed_share(b, targets, "cand_id")
    # entities bring their true candidates along, so that pairs are not moved to meet them
    a = a.join(true_lists(truth), "s1_id", "left")
    column, condition = NEGATIVES[kind]
    pairs = a.join(b, (F.col("s1_country") == F.col("c_country")) & (F.col(f"s1_{column}") == F.col(f"c_{column}"))).filter(condition)
    pairs = pairs.filter(is_true() == 0).withColumns({"label": F.lit(0), "pair_type": F.lit(kind)}).select(COLUMNS)
    return hashed_limit(pairs, most, "s1_id", "cand_id") if most else pairs


def training_set(norm: DataFrame, truth: DataFrame, most: int | dict[str, int] | None = None, sides: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Positives and mined negatives; ``most`` bounds each kind of the latter, by one number or by kind, and ``sides`` what they are mined from."""
    out = positives(norm, truth)
    for kind in NEGATIVES:
        out = out.unionByName(negatives(norm, truth, kind, most[kind] if isinstance(most, dict) else most, sides))
    return out


def country_confusion(norm: DataFrame, truth: DataFrame, cap: int = 250) -> DataFrame:
    """(s1_id, cand_id): equal names (5 characters or more, at most ``cap`` targets) in different countries, no true pair."""
    a, b = _sides(norm)
    a = a.join(true_lists(truth), "s1_id", "left")
    few = b.groupBy("c_name").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select("c_name")
    pairs = a.join(b.join(few, "c_name", "left_semi"), (F.col("s1_name") == F.col("c_name")) & (F.col("s1_country") != F.col("c_country"))).filter("length(s1_name) >= 5")
    return pairs.filter(is_true() == 0).select("s1_id", "cand_id")


def idf_shortlist(norm: DataFrame, max_df: int = 5000, top: int = 300) -> DataFrame:
    """(s1_id, cand_id, weight): name-token overlap weighted 1/log2(df + 2), frequent tokens left out."""
    rows = norm.select("entity_id", "source", F.explode(F.array_distinct(F.split("name_norm", " "))).alias("token")).filter("length(token) >= 2")
    df = rows.filter("source <> 1").groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    # a frequent token of either side is left out, so a token's pairs are bounded by the square of max_df
    own = rows.filter("source = 1").groupBy("token").agg(F.count("*").alias("own")).filter(F.col("own") <= max_df).select("token")
    a = rows.filter("source = 1").select(F.col("entity_id").alias("s1_id"), "token").join(df.join(own, "token", "left_semi"), "token")
    b = rows.filter("source <> 1").select(F.col("entity_id").alias("cand_id"), "token")
    scored = a.join(b, "token").groupBy("s1_id", "cand_id").agg(F.round(F.sum(1 / F.log2(F.col("df") + 2)), 6).alias("weight"))
    order = W.partitionBy("s1_id").orderBy(F.col("weight").desc(), "cand_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def confusion_examples(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """The strongest false pair of each category for each entity: same name apart in address, same
    address apart in name, alike in both."""
    kind = F.when((F.col("name_ratio") >= 0.8) & (F.col("address_ratio") < 0.5), "name").when((F.col("address_ratio") >= 0.8) & (F.col("name_ratio") < 0.5), "address").when((F.col("name_ratio") >= 0.6) & (F.col("address_ratio") >= 0.6), "both")
    wrong = labelled(scored, truth).filter("is_true = 0").withColumn("category", kind).filter("category is not null")
    order = W.partitionBy("s1_id", "category").orderBy(F.round("prob", 9).desc(), "cand_id")
    return wrong.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("s1_id", "cand_id", "category")


def random_negatives(norm: DataFrame, truth: DataFrame, per_entity: int = 2, buckets: int | None = None, seed: str = SEED) -> DataFrame:
    """Reproducible pairs by hash: entities and targets meet in hash buckets, each entity takes its first few.

    Buckets hold about 32 targets, so no bucket grows with the corpus.
    """
    target = norm.filter("source <> 1").select(F.col("entity_id").alias("cand_id"))
    n = buckets or max(1, target.count() // 32)
    place = lambda c: F.pmod(hash48(c, seed=seed), F.lit(n))
    a = norm.filter("source = 1").select(F.col("entity_id").alias("s1_id")).withColumn("b", place("s1_id"))
    pairs = a.join(target.withColumn("b", place("cand_id")), "b").join(truth, ["s1_id", "cand_id"], "left_anti")
    order = W.partitionBy("s1_id").orderBy(F.md5(F.concat("s1_id", "cand_id")), "cand_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_entity).select("s1_id", "cand_id", "rank")


def ratio_sample(training: DataFrame, ratio: int, positives: int | None = None) -> DataFrame:
    """All positives and ``ratio`` times as many negatives, those of least md5."""
    true = training.filter("label = 1")
    n = true.count() if positives is None else positives
    return true.unionByName(hashed_limit(training.filter("label = 0"), ratio * n, "s1_id", "cand_id", "pair_type"))


def ratio_sweep(training: DataFrame, ratios=(1, 2, 3, 4, 5)) -> DataFrame:
    """(ratio, label, pair_type, n) of the samples at each ratio of negatives to positives.

    The negatives are ranked by hash once: a bucket's rows among themselves,
    after the rows of all lesser buckets, of which there are 16**4 at most.
    Buckets beyond the largest sample are left out before rows are moved.
    """
    ids = ["s1_id", "cand_id", "pair_type"]
    n = training.filter("label = 1").count()
    hashed = training.filter("label = 0").select(*ids).withColumn("_md5", F.md5(F.concat(*ids, F.lit(SEED)))).withColumn("_bucket", F.conv(F.substring("_md5", 1, BUCKET_DIGITS), 16, 10).cast("long"))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("size"))
    before = sizes.select("_bucket", (F.sum("size").over(W.orderBy("_bucket")) - F.col("size")).alias("_before")).filter(F.col("_before") < max(ratios) * n)
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("_md5", *ids))
    ranked = hashed.join(F.broadcast(before), "_bucket").withColumn("rank", place + F.col("_before"))
    each = F.array(*(F.struct(F.lit(r).alias("ratio"), (F.col("rank") <= r * n).alias("taken")) for r in ratios))
    taken = ranked.select("pair_type", F.explode(F.filter(each, lambda x: x["taken"])).alias("x"))
    false = taken.groupBy(F.col("x.ratio").alias("ratio"), "pair_type").agg(F.count("*").alias("n")).select("ratio", F.lit(0).alias("label"), "pair_type", "n")
    true = training.filter("label = 1").groupBy("pair_type").agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, ratios))).alias("ratio"), F.lit(1).alias("label"), "pair_type", "n")
    return false.unionByName(true)


def class_weights(training: DataFrame) -> DataFrame:
    """(label, weight): n / (2 * n_class), from one count of the rows."""
    sizes = training.groupBy("label").agg(F.count("*").alias("_n"))
    return sizes.select("label", (F.sum("_n").over(W.partitionBy()) / (2.0 * F.col("_n"))).alias("weight"))


def balanced(training: DataFrame) -> DataFrame:
    """Adds class weights; rows stay where they are, as a join by label would leave two tasks with all of them."""
    return training.join(F.broadcast(class_weights(training)), "label")


def fit(training: DataFrame, kind: str = "gbt", columns=FEATURES_11, **params):
    """A pipeline model: boosted trees (``gbt``) or a random forest (``rf``), balanced by class weights.

    Rows are dealt evenly over all cores, one part for each, as every part has
    counts of its own for all nodes; a forest keeps the node of each row and
    tree, so that deep trees are not walked anew for every level.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    defaults = {"gbt": {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8}, "rf": {"numTrees": 250, "maxDepth": 14, "minInstancesPerNode": 3, "cacheNodeIds": True}}
    trees = {"gbt": GBTClassifier, "rf": RandomForestClassifier}[kind](featuresCol="features", labelCol="label", weightCol="weight", seed=int(SEED), **(defaults[kind] | params))
    rows = balanced(training).select(*columns, "label", "weight").repartition(training.sparkSession.sparkContext.defaultParallelism)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), trees]).fit(rows)


def predict(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
