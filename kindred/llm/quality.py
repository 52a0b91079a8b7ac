"""Quality rules: base counts and a hashed n-gram log-likelihood ratio (native Spark only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, word_array

#: log2 of the hash buckets of the two multinomials, and the n-grams that the prior of the target counts for.
BUCKET_BITS, PRIOR = 14, 65_536.0
#: Trusted documents that the target multinomial is fitted on, at most (chosen by hash of the id).
TARGET_SAMPLE = 4096
#: A document is kept from this mean log-likelihood ratio per n-gram on.
THRESHOLD = -0.1
WINDOW = 5


def windows(words: Column, hashes: Column) -> Column:
    """64-bit hashes of the windows of 5 words, by their place."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, the first one included.

    Texts without equal hashes (most) take one hash-set pass instead; here
    (hash, position) is sorted, and a sorted list of repeated positions p
    covers ``sum(min(5, next - p))`` words.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # the sorted list is bound once by a one-element transform
    places = F.element_at(
        F.transform(F.array(placed), lambda s: F.sort_array(F.transform(F.filter(s, lambda v, i: F.coalesce(F.get(s, i - 1)["h"] == v["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == v["h"], F.lit(False))), lambda v: v["p"]))), 1)
    spans = F.element_at(F.transform(F.array(places), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))), 1)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)


def buckets(hashes: Column, bits: int = BUCKET_BITS) -> Column:
    """Buckets of the words and of the pairs of neighbouring words, by word hashes."""
    size = F.lit(1 << bits)
    single = F.transform(hashes, lambda h: F.pmod(h, size).cast("int"))
    double = F.when(F.size(hashes) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 2, F.lit(0))), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(single, double)


def free(name: str, taken) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def trusted_ids(labels: DataFrame, most: int = TARGET_SAMPLE) -> DataFrame:
    """Ids of up to ``most`` documents labelled good and not toxic, those with the least hash."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratios(docs: DataFrame, targets: DataFrame, bits: int = BUCKET_BITS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row, one array: the log ratio of target to raw probability of every bucket.

    ``targets`` has the ids of the trusted documents, few enough to be sent to
    every task.  The raw multinomial counts every n-gram of every document;
    exploded buckets combine before the shuffle to at most 2**bits rows a task.
    """
    known = F.broadcast(targets.select(F.col(targets.columns[0]).alias("_id")).distinct().withColumn("_good", F.lit(True)))
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text")).join(known, F.col("_doc") == F.col("_id"), "left")
    rows = texts.select(F.coalesce("_good", F.lit(False)).alias("_trusted"), F.transform(word_array(F.col("_text")), lambda w: F.xxhash64(w)).alias("_hashes"))
    rows = rows.select("_trusted", F.explode(buckets(F.col("_hashes"), bits)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("_trusted").alias("target"))
    every = docs.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    # the target is smoothed towards the raw distribution, so few trusted documents decide little
    base = lambda c: c["raw"] / F.col("raws")
    ratio = lambda c: F.when(c["raw"] > 0, F.log((c["target"] + PRIOR * base(c)) / (F.col("targets") + PRIOR)) - F.log(base(c))).otherwise(0.0)
    return one.select(F.transform("c", ratio).alias("ratios"))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr (mean log ratio per n-gram) and kept.

    Null text has no words, so it fails the base rules (under 10 words); very
    long texts are read whole, a row at a time; an empty corpus gives no rows;
    without trusted documents every ratio is 0, so the base rules alone decide.
    A ratio at the threshold is kept.  Repeated rows are assessed alike, and so
    are rows without an id.  Columns of ``docs`` by these names are replaced;
    ``passing`` keeps every column.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, h, logs, win, lines, bucket, made = (free(c, docs.columns) for c in ("_words", "_hashes", "_logs", "_windows", "_lines", "_buckets", "_counts"))
    rows = docs.withColumn(w, word_array(F.col(text_col))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rows = rows.withColumn(logs, ratios(docs, trusted_ids(labels), bits, text_col, id_col).scalar())
    rows = rows.withColumn(win, windows(F.col(w), F.col(h)))
    rows = rows.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    rows = rows.withColumn(bucket, buckets(F.col(h), bits))
    n_words = F.size(w).cast("long")
    repeat = F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(_covered(F.col(win)))
    llr = F.when(F.size(bucket) > 0, F.aggregate(bucket, F.lit(0.0), lambda a, b: a + F.get(logs, b)) / F.size(bucket)).otherwise(0.0)
    counts = F.struct(
        n_words.alias("n_words"),
        F.length(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        llr.alias("llr"),
    )
    # The optimizer would push a filter on these columns below, and so evaluate the arrays again inside
    # the lambdas; an expression that it holds for non-deterministic keeps filters above this line.
    rows = rows.withColumn(made, F.when(F.monotonically_increasing_id() >= 0, counts))
    rows = rows.drop(w, h, win, lines, bucket, logs)
    rows = rows.withColumns({c: F.col(made)[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")}).drop(made)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
    rows = docs.select(docs["doc_id"], docs["text"], F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return assess(rows, labels, threshold).filter("kept").select("row.*")


OUTPUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def query(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*OUTPUT)
