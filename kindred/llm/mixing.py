"""Mixing sources to target weights with hash-threshold histograms (native Spark only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, written

#: Bits of a document's hash that one histogram resolves, and how many levels there are.
LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def hash60(key):
    """60 bits of the key's md5: the same in any engine, and on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=(3, 1, 2), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target): weights repeat over sources by code point, null last.

    Targets are ``min(cap * size, level * weight)`` with the one level at which
    they sum to the share; that is where resharing the excess by weight ends.
    Windows run in one task over one row per source: sources are the parts of a
    mix that are weighed by name, so their number is small whatever the corpus.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    limits = sums.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    by_fill = W.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    filled = limits.select(
        "*",
        (F.sum("source_size").over(everything) * share_percent / 100.0).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"),
        F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)).alias("weight_left"),
    ).withColumn("level", (F.col("total") - F.col("limit_before")) / F.col("weight_left"))
    # the first source, by fill, that the level of those left does not fill
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return filled.withColumn("found", level).select("source", "source_size", F.least("limit", F.coalesce(F.col("found") * F.col("weight"), F.col("limit"))).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("hash", hash60(F.col("doc_id"))), "mix")


def thresholds(rows: DataFrame, weights=(3, 1, 2), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(s, source_size, target, times, below) by source: every document is taken ``times`` times and
    once more if its hash is under ``below``.  ``rows`` has source, size, hash.

    ``below`` is found by nested histograms of 2**12 buckets, each over the
    boundary bucket of the one before, so nothing is sorted and no group is gathered.
    """
    targets = source_targets(rows, weights, share_percent, cap)
    targets = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = written(targets.withColumn("room", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    for k in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (k + 1)
        inside = rows if k == 0 else (
            rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
            .filter(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        )
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        placed = sums.withColumn("upto", running).select(F.col("source").alias("s"), "bucket", "size", "upto")
        # the boundary bucket is the first one that the room does not hold
        edge = (
            state.select(F.col("source").alias("t"), F.col("room").alias("r")).join(placed, F.col("t").eqNullSafe(F.col("s")))
            .filter("upto > r").groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("used"), F.col("size").alias("next"))).alias("e"))
        )
        # no bucket beyond the room: everything in this range is taken
        past = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        state = written(
            state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "times",
                (F.col("room") - F.coalesce("e.used", F.lit(0))).alias("room"),
                F.coalesce("e.bucket", past).alias("prefix"),
                F.col("e.next").alias("next"),
            ),
            "mix-targets",
        )
    nearer = F.coalesce(F.col("next") - F.col("room") < F.col("room"), F.lit(False))
    return state.select(F.col("source").alias("s"), "source_size", "target", "times", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def copies(hash_col: Column, cap: int = 2) -> Column:
    """How often a document is taken, where ``thresholds`` are joined."""
    return F.least(F.col("times") + F.when(hash_col < F.col("below"), 1).otherwise(0), F.lit(cap))


def mix(docs: DataFrame, weights=(3, 1, 2), share_percent: int = 150, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    A source whose target is r times its size takes every document floor(r)
    times, and once more those whose hash is below the source's threshold: the
    largest prefix by hash that stays within the rest of the budget, or one
    hash more where that comes nearer.  Null text has size 0, very long texts
    are counted whole, null is a source of its own, repeated ids share a hash and go together, an empty table gives
    no rows, other columns are ignored.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    out = rows.join(thresholds(rows, weights, share_percent, cap), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"), cap)).alias("taken"))


def mixed(docs: DataFrame, weights=(3, 1, 2), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    Texts are not shuffled: the thresholds, one row a source, are joined to the rows.
    """
    found = thresholds(_sized(docs, "doc_id", "text", "source"), weights, share_percent, cap).select("s", "times", "below")
    # the caller's columns travel as one, whatever their names
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].alias("key"), hash60(docs["doc_id"]).alias("hash"))
    taken = rows.join(found, F.col("key").eqNullSafe(F.col("s"))).select("row", copies(F.col("hash"), cap).cast("long").alias("n"))
    return taken.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
             CAST(2 * source_size AS DOUBLE) AS lim FROM s),
f AS (SELECT *, (sum(source_size) OVER ()) * 150 / 100.0::DOUBLE AS total,
             coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
v AS (SELECT arg_min((total - before) / rest, lim / weight) AS level FROM f WHERE (total - before) / rest * weight <= lim),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * weight) END AS target FROM f, v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, hash, sum(size) AS size FROM d GROUP BY source, hash),
r AS (SELECT g.*, u.target - u.times * u.source_size AS room, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.hash) AS upto
      FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source),
e AS (SELECT source, arg_min(upto - size, hash) AS used, arg_min(size, hash) AS nxt, min(hash) AS edge, any_value(room) AS room
      FROM r WHERE upto > room GROUP BY source)
SELECT d.doc_id, d.size, u.source_size, u.target,
       CAST(d.size * least(2, u.times + CASE WHEN e.edge IS NULL OR d.hash < e.edge
            OR (d.hash = e.edge AND e.nxt - (e.room - e.used) < e.room - e.used) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")
