"""Readers and sinks: tab-separated entity files, truth, wide candidate lists, results, reports, models."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []
ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
CANDIDATES = "source1_entity_id string, candidate_entity_ids string"
MATCHES = "source1_entity_id string, matched_entity_ids string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kindred-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def register(spark: SparkSession, frame, name: str, schema: str | None = None) -> DataFrame:
    """A frame of the driver (pandas, Arrow or rows) as a table that SQL finds by name."""
    out = spark.createDataFrame(frame, schema) if schema else spark.createDataFrame(frame)
    out.createOrReplaceTempView(name)
    return out


#: Held while a table is written: shuffle files go when the write has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def writing(spark: SparkSession):
    """For a write that runs once; the session's own setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and kept if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/kindred/{name}-{uuid.uuid4().hex}"
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Gives ``write(df, name)``: like ``materialised``, but the tables are removed at the end."""
    folder = f"{shared_dir(spark)}/kindred/scratch-{uuid.uuid4().hex}"

    def write(df: DataFrame, name: str) -> DataFrame:
        with writing(spark):
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield write
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    return line[0].lstrip("\ufeff").split("\t") if line else []


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` of a header TSV, all strings, found by name; doubled quotes inside quoted fields are one quote.

    The header line alone is read first; nothing is inferred.  Other columns are not parsed into the result.
    """
    wanted = [f.split()[0] for f in schema.split(", ")]
    there = _header(spark, path)
    known = T.StructType([T.StructField(c, T.StringType()) for c in (there if set(wanted) <= set(there) else wanted)])
    return spark.read.csv(path, sep="\t", header=True, schema=known, quote='"', escape='"').select(wanted)


def require(spark: SparkSession, paths: list[str], schema: str, exact: bool = False) -> None:
    """Raises unless every path is there and its header has the columns of ``schema`` (``exact``: these alone, in order)."""
    wanted = [f.split()[0] for f in schema.split(", ")]
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            raise FileNotFoundError(path)
        found = _header(spark, path)
        if found != wanted if exact else not set(wanted) <= set(found):
            raise ValueError(f"{path} has the columns {found}, not {wanted}")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ENTITY)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(first, rest) of each non-blank line after the header, split at the first tab."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("first"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("rest")).filter(~F.col("first").isin("source1_entity_id", "entity_id"))


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids, column, "left_semi")


def unnest(wide: DataFrame, column: str, name: str) -> DataFrame:
    """(source1_entity_id, name): the comma list of a wide table as rows; blanks drop, items are trimmed."""
    items = wide.select("source1_entity_id", F.explode(F.split(column, ",")).alias(name)).withColumn(name, F.trim(name))
    return items.filter((F.col(name).isNotNull()) & (F.col(name) != ""))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """A header TSV whose blanks are empty fields without quotes."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small metrics table as JSON lines."""
    rows.coalesce(1).write.mode("errorifexists").json(path)


def render_report(rows: DataFrame, most: int = 1000) -> str:
    """A small metrics table as fixed-width text; a table of more than ``most`` rows is refused, not cut."""
    found = rows.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    return found.to_string(index=False)


def save_model(model, path: str, features: list[str], threshold: float) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features, "threshold": threshold}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_model(spark: SparkSession, path: str):
    """(model, features, threshold)."""
    from pyspark.ml import PipelineModel

    side = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return PipelineModel.load(f"{path}/model"), side["features"], side["threshold"]
