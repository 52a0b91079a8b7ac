"""Micro-batch use: new source-1 entities on a stream are matched with a fixed table of targets.

Matching an entity needs its own row and the targets only, so a micro-batch is
a batch; nothing is kept between batches but the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking
from kindred.plans import matcher
from kindred.sources.config import Settings


def normalized_stream(stream: DataFrame) -> DataFrame:
    """Adds the normalised fields and block keys to a streaming entity table."""
    return blocking.normalized(stream)


def match_stream(stream: DataFrame, targets: DataFrame, path: str, checkpoint: str, settings: Settings | None = None, model=None, **trigger) -> StreamingQuery:
    """Writes each micro-batch's matches to ``path/batch=<id>``, a row per entity.

    ``stream`` has the entity columns; ``targets`` has them and a source, and is
    normalised already.  A batch that is run again after a failure replaces its
    own folder, so every entity of the stream has its matches once.
    """
    settings = settings or Settings()

    def match(batch: DataFrame, number: int) -> None:
        norm = blocking.normalized(blocking.dedupe(batch.withColumn("source", F.lit(1)))).unionByName(targets)
        pairs = blocking.candidates(norm, settings.passes, settings.block_cap)
        matcher.decide(norm, pairs, settings, model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
