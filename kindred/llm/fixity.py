"""WARC fixity: Merkle trees over records and ordered offset ranges, and a replica audit."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, give_back, shuffle_width, table, written
from .mixing import hash60

#: log2 of the children of a tree node; records of a key that hash as one list, copies that are numbered together, nodes of a file.
FANOUT_BITS, LIST_ROWS, COPIES, NODES_PER_FILE = 6, 256, 4096, 50_000
END = "\r\n\r\n"


# --- records and files --------------------------------------------------------------


def warc_record(url: Column, body: Column, record_id: Column | None = None, date: Column | None = None) -> Column:
    """One WARC/1.0 response record as text; null url or body counts as empty, a missing id or date has no line."""
    body = F.coalesce(body, F.lit(""))
    line = lambda name, value, open_="", close="": F.coalesce(F.concat(F.lit(f"{name}: {open_}"), value, F.lit(f"{close}\r\n")), F.lit(""))
    more = [line("WARC-Record-ID", record_id, "<", ">")] if record_id is not None else []
    more += [line("WARC-Date", F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"))] if date is not None else []
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\n"), *more, F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body, F.lit(END),
    )


def write_warc(records: DataFrame, column: str, path: str, per_file: int = 10_000) -> None:
    """Writes records (as ``warc_record`` makes them) one after another into files of at most ``per_file`` of them."""
    body = F.left(F.col(column), F.length(column) - len(END))
    records.select(body.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


_FIELDS = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri")
READ = "file string, offset long, n_bytes long, type string, record_id string, date string, url string, body binary, record binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, n_bytes, type, record_id, date, url, body, record) of each record of each file.

    A file is one task; it is read whole, so files have a bounded number of
    records.  What is no record where one should begin, or ends before its
    length, is an error that names the file and the offset.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                at, rows = 0, []
                while at < len(data):
                    head = data.find(END.encode(), at)
                    if not data.startswith(b"WARC/", at) or head < 0:
                        raise ValueError(f"no record at {at} of {name}")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head].decode().split("\r\n")[1:])}
                    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
                        raise ValueError(f"no length at {at} of {name}")
                    low = head + len(END)
                    high = low + int(fields["content-length"])
                    stop = high + len(END)
                    if data[high:stop] != END.encode():
                        raise ValueError(f"the record at {at} of {name} does not end at its length")
                    rows.append((name, at, stop - at, *(fields.get(f) for f in _FIELDS), data[low:high], data[at:stop]))
                    at = stop
                    if len(rows) >= 500 or at >= len(data):
                        kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])
                        rows = []

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(lambda b: give_back(run(b)), READ)


# --- trees ----------------------------------------------------------------------------


def leaves(records: DataFrame, id_col: str, record: Column) -> DataFrame:
    """(key, id, n_bytes, digest) of each record. Only digests leave the scan."""
    return records.select(F.col(id_col).cast("long").alias("key"), F.col(id_col).alias("id"), F.octet_length(record).cast("long").alias("n_bytes"), F.sha2(record.cast("binary"), 256).alias("digest"))


def _place(low: int) -> Column:
    """Where a key is in the tree: its distance from the least key, after a first range that null keys have to themselves."""
    return F.coalesce(F.col("key") - low + (1 << FANOUT_BITS), F.lit(0).cast("long"))


def items(leaf_rows: DataFrame, low: int) -> DataFrame:
    """(at, digest, n, n_bytes): the records of each place that are equal, with their number and the bytes of one."""
    return leaf_rows.groupBy(_place(low).alias("at"), "digest").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.max("id").alias("id"))


def _range_hash(children: Column) -> Column:
    """A hash over children (name, n_bytes, hash) in order, with the offset at which each one begins."""
    start = F.struct(F.lit("").alias("said"), F.lit(0).cast("long").alias("at"))
    add = lambda a, c: F.struct(F.concat(a["said"], F.concat_ws(":", c["name"].cast("string"), a["at"].cast("string"), c["n_bytes"].cast("string"), c["hash"]), F.lit(",")).alias("said"), (a["at"] + c["n_bytes"]).alias("at"))
    return F.sha2(F.aggregate(F.sort_array(children), start, add, lambda a: a["said"]).cast("binary"), 256)


def _few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, of which there are ``most`` at most, in as few files as that asks for."""
    return rows.coalesce(min(shuffle_width(rows.sparkSession), 1 + most // NODES_PER_FILE))


def tree(things: DataFrame, depth: int, digits: int, span: int) -> list[DataFrame]:
    """Node tables (node, n_records, n_bytes, hash) from the leaf ranges (level 0) up to the root.

    A node of level k covers the places with the same ``at >> bits*(k+1)``
    (level 0: 64 neighbouring keys), in key order, so a lost record moves no
    other node.  Its hash is over its children in order: name, offset within
    the node, bytes, hash.  A node has at most 64 children.  The records of one
    place are a tree of their own over hex digits of their digests, as deep as
    the largest place needs, so no list grows with a key's repeats.  ``span``
    is the number of places, which bounds the nodes of each level.
    """
    child = lambda name: F.struct(name.alias("name"), F.col("n_bytes"), F.col("hash"))
    gather = lambda rows, by, name: rows.groupBy(*by).agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.collect_list(child(name)).alias("c")).withColumn("hash", _range_hash(F.col("c"))).drop("c")
    rows = things.select("at", "digest", F.col("n").alias("n_records"), (F.col("n") * F.col("n_bytes")).alias("n_bytes"), F.concat_ws("x", "digest", F.col("n").cast("string")).alias("hash"))
    name = F.col("digest")
    for d in range(digits, -1, -1):
        rows = gather(rows, ["at", F.left("digest", F.lit(d)).alias("digest")], name)
    rows, out = rows.drop("digest").withColumnRenamed("at", "node"), []
    for _ in range(depth):
        span = (span >> FANOUT_BITS) + 1
        rows = written(_few(gather(rows, [F.shiftright("node", FANOUT_BITS).alias("up")], F.col("node")).withColumnRenamed("up", "node"), span), "merkle")
        out.append(rows)
    return out


def depth_for(span: int) -> int:
    """Levels until one root covers ``span`` keys."""
    depth = 1
    while span >> (FANOUT_BITS * depth):
        depth += 1
    return depth


def suspects(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaf ranges whose hashes differ, found by descending from the roots through differing nodes only."""
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        above = bad
        if above is not None:
            up = above.withColumnRenamed("node", "up")
            a, b = (x.join(up, F.shiftright("node", FANOUT_BITS) == F.col("up"), "left_semi") for x in (a, b))
        bad = a.select("node", "hash").join(b.select("node", F.col("hash").alias("other")), "node", "full").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("node")
        bad = written(bad.coalesce(max(1, shuffle_width(bad.sparkSession) // 8)), "merkle-bad")
        if above is not None:
            discard(above)
    return bad


def starts(levels: list[DataFrame]) -> DataFrame:
    """(node, offset) of the leaf ranges: bytes are summed among siblings from the root down, so no window is wider than a node."""
    start = levels[-1].select("node", F.lit(0).cast("long").alias("offset"))
    inner = W.partitionBy("up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    for level in reversed(levels[:-1]):
        part = level.select("node", "n_bytes", F.shiftright("node", FANOUT_BITS).alias("up"))
        part = part.withColumn("within", F.coalesce(F.sum("n_bytes").over(inner), F.lit(0)))
        start = part.join(start.withColumnRenamed("node", "up"), "up").select("node", (F.col("offset") + F.col("within")).alias("offset"))
    return start


def offsets(things: DataFrame, start: DataFrame, digits: int) -> DataFrame:
    """Adds to the items of a replica the byte offset of the first of their equal records, in (key, digest) order.

    ``start`` has the leaf ranges' offsets.  Places are summed within their leaf range, runs of digests within their
    place by one digit more at a time, and items within a run: every window is
    over a bounded number of rows.
    """
    before = lambda by, order: F.coalesce(F.sum("bytes").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = things.withColumn("bytes", F.col("n") * F.col("n_bytes"))
    sums = rows.groupBy("at").agg(F.sum("bytes").alias("bytes")).withColumn("node", F.shiftright("at", FANOUT_BITS))
    start = sums.withColumn("within", before(["node"], "at")).join(start, "node").select("at", F.lit("").alias("run"), (F.col("offset") + F.col("within")).alias("offset"))
    for d in range(1, digits + 1):
        runs = rows.groupBy("at", F.left("digest", F.lit(d)).alias("next")).agg(F.sum("bytes").alias("bytes")).withColumn("run", F.left("next", F.lit(d - 1)))
        start = runs.withColumn("within", before(["at", "run"], "next")).join(start, ["at", "run"]).select("at", F.col("next").alias("run"), (F.col("offset") + F.col("within")).alias("offset"))
    placed = rows.withColumn("run", F.left("digest", F.lit(digits))).withColumn("within", before(["at", "run"], "digest"))
    return placed.join(start, ["at", "run"]).withColumn("offset", F.col("offset") + F.col("within")).drop("run", "within", "bytes")


def _copies(rows: DataFrame, count: str) -> DataFrame:
    """A row for each of ``count`` copies, numbered ``copy`` from 0, many copies a few thousand at a time in tasks of their own."""
    chunks = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES))))
    spread = chunks.filter(f"{count} <= {COPIES}").unionByName(chunks.filter(f"{count} > {COPIES}").repartition("at", "digest", "_chunk"))
    last = F.least(F.col(count), (F.col("_chunk") + 1) * COPIES) - 1
    return spread.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * COPIES, last))).drop("_chunk")


def _build(ours: DataFrame, theirs: DataFrame):
    """(least key, items and trees of both, digits, suspects); None for two empty replicas."""
    both = ours.select("key").union(theirs.select("key"))
    edge = both.agg(F.count("*"), F.coalesce(F.min("key"), F.lit(0)), F.coalesce(F.max("key"), F.lit(0))).first()
    if not edge[0]:
        return None
    low, span = edge[1], edge[2] - edge[1] + (1 << FANOUT_BITS) + 1
    depth = depth_for(span >> FANOUT_BITS) + 1
    a, b = written(items(ours, low), "items"), written(items(theirs, low), "items")
    most = a.union(b).groupBy("at").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
    digits = 0
    while most >> (4 * digits) > LIST_ROWS:
        digits += 1
    trees = tree(a, depth, digits, span), tree(b, depth, digits, span)
    return low, (a, b), trees, digits, suspects(*trees)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, offset, n_bytes, digest, status) of every record of ours, and of records only theirs.

    ``ours`` and ``theirs`` are leaf tables.  Equal records of a key are matched
    copy by copy.  Of what is left of a key, a record of ours is ``corrupt`` as long as
    the other replica has one left too, which is then its other version, and
    ``missing`` beyond that; what is left of theirs is ``extra`` (offset null).
    Among the records left of a key the least digests come first.  Only ranges
    under differing nodes are compared record by record.  Null ids are a key of
    their own, before all others.  Empty replicas give empty results.
    """
    built = _build(ours, theirs)
    if built is None:
        return ours.select("id", F.lit(0).cast("long").alias("offset"), "n_bytes", "digest", F.lit("ok").alias("status"))
    low, (a, b), trees, digits, bad = built
    begins = written(starts(trees[0]).coalesce(max(1, shuffle_width(ours.sparkSession) // 8)), "starts")
    in_bad = lambda x: x.join(bad, F.shiftright("at", FANOUT_BITS) == bad["node"], "left_semi")
    side = lambda x, p: in_bad(x).select("at", "digest", F.col("n").alias(f"{p}_n"), F.col("n_bytes").alias(f"{p}_bytes"), F.col("id").alias(f"{p}_id"))
    met = side(a, "here").join(side(b, "there"), ["at", "digest"], "full")
    met = written(met.withColumns({"same": F.least(F.coalesce("here_n", F.lit(0)), F.coalesce("there_n", F.lit(0)))}).withColumns({"here_left": F.coalesce("here_n", F.lit(0)) - F.col("same"), "there_left": F.coalesce("there_n", F.lit(0)) - F.col("same")}), "met")
    # of the records left of a place, as many are corrupt as both have; runs of digests keep the sums' windows small
    left = met.filter("here_left > 0 or there_left > 0").withColumn("run", F.left("digest", F.lit(digits)))
    total = left.groupBy("at").agg(F.least(F.sum("here_left"), F.sum("there_left")).alias("corrupt"))
    runs = left.groupBy("at", "run").agg(F.sum("here_left").alias("h"), F.sum("there_left").alias("t"))
    start = runs.select("at", F.lit("").alias("run")).distinct().withColumns({"h0": F.lit(0).cast("long"), "t0": F.lit(0).cast("long")})
    upto = lambda c, by, order: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    for d in range(1, digits + 1):
        next_ = runs.groupBy("at", F.left("run", F.lit(d)).alias("next")).agg(F.sum("h").alias("h"), F.sum("t").alias("t")).withColumn("run", F.left("next", F.lit(d - 1)))
        next_ = next_.withColumns({"hw": upto("h", ["at", "run"], "next"), "tw": upto("t", ["at", "run"], "next")}).join(start, ["at", "run"])
        start = next_.select("at", F.col("next").alias("run"), (F.col("h0") + F.col("hw")).alias("h0"), (F.col("t0") + F.col("tw")).alias("t0"))
    left = left.withColumns({"hw": upto("here_left", ["at", "run"], "digest"), "tw": upto("there_left", ["at", "run"], "digest")}).join(start, ["at", "run"]).join(total, "at")
    # how many of the copies left are corrupt: those that come before the place's number of them is used up
    within = lambda n, first: F.greatest(F.lit(0), F.least(F.col(n), F.col("corrupt") - first))
    left = left.withColumns({"corrupt_n": within("here_left", F.col("h0") + F.col("hw")), "matched_n": within("there_left", F.col("t0") + F.col("tw"))})
    verdict = left.filter("here_n is not null").select("at", "digest", "same", "corrupt_n")
    discard(*trees[0], *trees[1])
    placed = offsets(a, begins, digits).join(verdict, ["at", "digest"], "left")
    copy = _copies(placed, "n")
    status = F.when(F.col("same").isNull() | (F.col("copy") < F.col("same")), "ok").when(F.col("copy") < F.col("same") + F.col("corrupt_n"), "corrupt").otherwise("missing")
    rows = copy.select("id", (F.col("offset") + F.col("copy") * F.col("n_bytes")).alias("offset"), "n_bytes", "digest", status.alias("status"))
    surplus = left.withColumn("surplus", F.col("there_left") - F.col("matched_n")).filter("surplus > 0")
    extra = _copies(surplus, "surplus").select(F.col("there_id").alias("id"), F.lit(None).cast("long").alias("offset"), F.col("there_bytes").alias("n_bytes"), "digest", F.lit("extra").alias("status"))
    out = written(rows.unionByName(extra), "audit")
    discard(a, b, begins, bad, met)
    return out


def differing_ranges(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(first_key, offset, n_bytes, their_offset, their_bytes) of each leaf range whose hashes differ: the byte
    ranges of both replicas, each laid out in (key, digest) order, that hold all differences.  first_key is null for the range of null ids."""
    built = _build(ours, theirs)
    if built is None:
        return ours.select(*(F.lit(None).cast("long").alias(c) for c in ("first_key", "offset", "n_bytes", "their_offset", "their_bytes"))).limit(0)
    low, (a, b), trees, _, bad = built
    one = lambda t, o, n: t[0].join(starts(t), "node").select("node", F.col("offset").alias(o), F.col("n_bytes").alias(n))
    found = bad.join(one(trees[0], "offset", "n_bytes"), "node", "left").join(one(trees[1], "their_offset", "their_bytes"), "node", "left")
    first = F.when(F.col("node") > 0, F.shiftleft("node", FANOUT_BITS) + low - (1 << FANOUT_BITS))
    out = written(found.select(first.alias("first_key"), "offset", "n_bytes", "their_offset", "their_bytes"), "ranges")
    discard(a, b, *trees[0], *trees[1], bad)
    return out


def query(spark, sf_dir):
    """Audits an archive of all pages against a replica with planted rot: by the id's hash, about one page
    in 41 has a byte more, one in 43 is lost, and one in 47 has a stray record with an id of its own (offset -1)."""
    pages = table(spark, sf_dir, "pages")
    h = hash60(F.col("page_id"))
    rotten = F.when(h % 41 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("\0"))).otherwise(F.col("html"))
    kept = pages.filter(h % 43 != 0).select("page_id", "url", rotten.alias("html"))
    stray = pages.filter(h % 47 == 0).select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit("stray").alias("html"))
    record = warc_record(F.col("url"), F.col("html"))
    found = audit(leaves(pages, "page_id", record), leaves(kept.unionByName(stray), "page_id", record))
    return found.select(F.col("id").alias("page_id"), F.coalesce("offset", F.lit(-1)).alias("offset"), "n_bytes", "digest", "status")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM pages),
r AS (
  SELECT page_id, h, kind, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)
         || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, url, html, h, 'ours' AS kind FROM p UNION ALL SELECT -1 - page_id, url, 'stray', h, 'stray' FROM p WHERE h % 47 = 0)),
d AS (SELECT page_id, kind, CAST(strlen(record) AS BIGINT) AS n_bytes, sha256(record) AS digest, h FROM r)
SELECT page_id, CAST(coalesce(sum(n_bytes) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       n_bytes, digest, CASE WHEN h % 43 = 0 THEN 'missing' WHEN h % 41 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM d WHERE kind = 'ours'
UNION ALL SELECT page_id, -1, n_bytes, digest, 'extra' FROM d WHERE kind = 'stray'
"""
