"""Recall of candidates, precision, recall and F0.5 by threshold, breakdowns and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.975, 0.99]
# The grid on which the operating point is chosen.
MACRO_THRESHOLDS = [0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.975, 0.98]


def f_half(p, r):
    """F0.5 of precision and recall, 0 where undefined."""
    d = 0.25 * p + r
    return F.when(d > 0, 1.25 * p * r / d).otherwise(0.0)


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def labelled(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds is_true; pairs that have it already (``blocking.met``) are not moved."""
    if "is_true" in scored.columns:
        return scored
    return scored.join(truth.withColumn("is_true", F.lit(1)), ["s1_id", "cand_id"], "left").na.fill(0, ["is_true"])


def candidate_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    hits = truth.join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    out = hits.agg(F.count("*").alias("true_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return out.withColumn("recall", F.round(ratio(F.col("found"), F.col("true_pairs")), 9))


def sweep(scored: DataFrame, truth: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per threshold: counts within the candidates and rates, candidate-level and end to end.

    Each pair falls in one step of the grid, so the pairs are scanned once, into a
    row a step; the steps are summed from the top, and all of them give the totals.
    """
    spark = scored.sparkSession
    step = sum((F.col("prob") >= t).cast("int") for t in thresholds)
    steps = labelled(scored, truth).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("is_true").alias("t"))
    one = steps.agg(F.collect_list(F.struct("step", "n", "t")).alias("steps"))  # at most a row for each threshold and one more
    grid = spark.createDataFrame([(float(t), i + 1) for i, t in enumerate(sorted(thresholds))], "threshold double, at int")
    total = lambda field, from_at: F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.when(s["step"] >= from_at, s[field]).otherwise(0))
    per = grid.withColumn("steps", one.scalar()).select("threshold", total("n", F.col("at")).alias("predictions"), total("t", F.col("at")).alias("true_positives"), total("t", F.lit(0)).alias("_rec"), total("n", F.lit(0)).alias("_n"))
    out = per.withColumn("_all", truth.agg(F.count("*")).scalar())
    tp, pred = F.col("true_positives"), F.col("predictions")
    out = out.withColumns({"false_positives": pred - tp, "false_negatives": F.col("_rec") - tp, "true_negatives": F.col("_n") - pred - F.col("_rec") + tp, "precision": ratio(tp, pred), "recall": ratio(tp, F.col("_rec")), "end_to_end_recall": ratio(tp, F.col("_all"))})
    out = out.withColumns({"f_half": f_half(F.col("precision"), F.col("recall")), "end_to_end_f_half": f_half(F.col("precision"), F.col("end_to_end_recall"))}).drop("_all", "_rec", "_n")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "end_to_end_recall", "f_half", "end_to_end_f_half")})


def _entity_f_half(t, p, tp):
    """F0.5 of one entity: 1 where nothing is true or predicted, 0 where one side is empty or nothing hits."""
    return F.when((t == 0) & (p == 0), 1.0).when((t == 0) | (tp == 0), 0.0).otherwise(f_half(tp / p, tp / t))


def macro_sweep(s1: DataFrame, truth: DataFrame, ranked: DataFrame, thresholds=MACRO_THRESHOLDS) -> DataFrame:
    """One row per threshold: predictions, hits, precision, end-to-end recall, macro and micro F0.5.

    ``ranked`` are the decisions at the least threshold, capped per source
    (``scoring.top_per_source``).  The best k above a threshold are those of the
    best k at all that are above it, so one ranking serves the whole grid; an
    entity has few of them, and every threshold is a column of one aggregation.
    """
    true = truth.groupBy("s1_id").agg(F.count("*").alias("t"))
    kept = labelled(ranked, truth).select("s1_id", "prob", "is_true").groupBy("s1_id").agg(F.collect_list(F.struct("prob", "is_true")).alias("kept"))
    rows = s1.select(F.col("entity_id").alias("s1_id")).join(true, "s1_id", "left").join(kept, "s1_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    kept = F.coalesce("kept", F.array().cast("array<struct<prob:double,is_true:int>>"))

    def above(x: float):
        p, tp = F.size(F.filter(kept, lambda k: k["prob"] >= x)), F.size(F.filter(kept, lambda k: (k["prob"] >= x) & (k["is_true"] == 1)))
        return F.struct(F.lit(float(x)).alias("threshold"), p.alias("p"), tp.alias("tp"))

    at = F.array(*map(above, thresholds))
    each = rows.select("t", F.explode(at).alias("at")).select("t", "at.*")
    per = each.groupBy("threshold").agg(F.sum("p").alias("predictions"), F.sum("tp").alias("true_positives"), F.count_if(F.col("p") == 0).alias("no_match_count"), F.avg(_entity_f_half(F.col("t"), F.col("p"), F.col("tp"))).alias("macro_f_half"), F.sum("t").alias("_all"))
    precision, recall = ratio(F.col("true_positives"), F.col("predictions")), ratio(F.col("true_positives"), F.col("_all"))
    out = per.withColumns({"false_positives": F.col("predictions") - F.col("true_positives"), "precision": precision, "recall": recall, "micro_f_half": f_half(precision, recall)}).drop("_all")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "macro_f_half", "micro_f_half")})


def best_threshold(swept: DataFrame, by: str = "end_to_end_f_half") -> DataFrame:
    """The threshold of the greatest value, the least of ties."""
    return swept.orderBy(F.col(by).desc(), "threshold").limit(1).select("threshold", by)


def macro_f_half(s1: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Mean F0.5 over all entities: 1 where nothing is true or predicted, 0 where one side is empty or nothing hits."""
    t = truth.groupBy("s1_id").agg(F.count("*").alias("t"))
    p = labelled(predictions, truth).select("s1_id", "is_true").groupBy("s1_id").agg(F.count("*").alias("p"), F.sum("is_true").alias("tp"))
    rows = s1.select(F.col("entity_id").alias("s1_id")).join(t, "s1_id", "left").join(p, "s1_id", "left").na.fill(0)
    each = _entity_f_half(F.col("t"), F.col("p"), F.col("tp"))
    return rows.agg(F.count("*").alias("entities"), F.count_if(F.col("p") == 0).alias("no_match_count"), F.round(F.avg(each), 9).alias("macro_f_half"))


def fn_breakdown(scored: DataFrame, pairs: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(kind, n): true pairs found, lost by the model, and lost by blocking."""
    kept = scored.filter(F.col("prob") >= threshold).select("s1_id", "cand_id", F.lit(1).alias("kept"))
    rows = truth.join(pairs.withColumn("cand", F.lit(1)), ["s1_id", "cand_id"], "left").join(kept, ["s1_id", "cand_id"], "left")
    kind = F.when(F.col("cand").isNull(), "blocking_miss").when(F.col("kept").isNull(), "model_miss").otherwise("found")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def error_taxonomy(scored: DataFrame, pairs: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(s1_id, cand_id, error): A true but no candidate, B true with a low score, C false with a high one.

    ``pairs`` are the candidates, or those of them that are true; a candidate may have no score.
    """
    missed = truth.join(pairs if pairs is not None else scored.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    true = F.col("is_true") == 1
    kind = F.when(true & (F.col("prob") < threshold), "B").when(~true & (F.col("prob") >= threshold), "C")
    wrong = labelled(scored, truth).select("s1_id", "cand_id", kind.alias("error")).filter("error is not null")
    return missed.select("s1_id", "cand_id", F.lit("A").alias("error")).unionByName(wrong)


def quantiles(df: DataFrame, column: str) -> DataFrame:
    points = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    q = df.agg(F.percentile(column, F.array(*map(F.lit, points))).alias("q"), F.avg((F.col(column) >= 0.8).cast("double")).alias("share"))
    return q.select(*(F.round(F.col("q")[i], 6).alias(f"q{int(p * 100)}") for i, p in enumerate(points)), F.round("share", 6).alias("share_080"))


def label_audit(training: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts that should be 0: repeated pairs, pairs of both labels, ids in both splits."""
    # pairs are dealt once, by pair, for both counts
    each = training.select("s1_id", "cand_id", "pair_type", "label").repartition("s1_id", "cand_id").groupBy("s1_id", "cand_id", "pair_type").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    pairs = each.groupBy("s1_id", "cand_id").agg(F.count_if(F.col("n") > 1).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_pairs"), F.count_if(F.col("low") < F.col("high")).alias("both_labels"))
    both = splits.groupBy("entity_id").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("both_splits").alias("check"), "n")
    two = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("repeated_pairs", "both_labels"))))
    return found.select(two.alias("x")).select("x.*").unionByName(both)


def target_leakage(truth: DataFrame, splits: DataFrame) -> DataFrame:
    """(targets, both, share): targets that truth links with entities, and those linked with entities of more than one split."""
    per = truth.join(splits.withColumnRenamed("entity_id", "s1_id"), "s1_id").groupBy("cand_id").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    out = per.agg(F.count("*").alias("targets"), F.count_if(F.col("low") < F.col("high")).alias("both"))
    return out.withColumn("share", F.round(ratio(F.col("both"), F.col("targets")), 9))


def output_audit(result: DataFrame, s1: DataFrame) -> DataFrame:
    """Rows of a result against source-1 rows, and how many have matches."""
    out = result.agg(F.count("*").alias("rows"), F.countDistinct("source1_entity_id").alias("entities"), F.count_if(F.col("matched_entity_ids") != "").alias("with_matches"))
    return out.withColumn("expected", s1.agg(F.count("*")).scalar()).withColumn("complete", (F.col("rows") == F.col("expected")) & (F.col("entities") == F.col("expected")))


def guardrails(before: dict, after: dict, most_growth: float = 3.0, most_loss: float = 0.05) -> bool:
    """Whether a new blocking may replace the old one: recall rises, F0.5 falls little, pairs grow little."""
    return after["recall"] > before["recall"] and after["f_half"] >= before["f_half"] * (1 - most_loss) and after["pairs"] <= before["pairs"] * most_growth
