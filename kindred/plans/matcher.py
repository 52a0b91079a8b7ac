"""The matcher end to end, and the shared intermediate tables of the registered queries.

``python -m kindred.plans.matcher`` runs files to files with the settings of
the environment (``LINK_INPUT_DIR``, ``LINK_OUTPUT_DIR`` and others).
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluate, scoring, training
from kindred.sources import fixture, tables
from kindred.sources.config import Settings, run_id

log = logging.getLogger(__name__)
SOURCES = (1, 2, 3)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.normalized(fixture.entities(spark, sf_dir))


def scored(norm: DataFrame, passes=blocking.PASSES, cap: int = blocking.CAP) -> DataFrame:
    """Candidates with attributes, features and the fixed scorer's probability."""
    return scoring.score_logit(scoring.features(scoring.attributes(blocking.candidates(norm, passes, cap), norm)))


def matches(scores: DataFrame, threshold: float, per_source: int = 3) -> DataFrame:
    return scoring.top_per_source(scoring.at_least(scoring.disambiguated(scores), threshold), per_source)


def decide(norm: DataFrame, pairs: DataFrame, settings: Settings, model=None) -> DataFrame:
    """Pairs to one row per source-1 entity; ``model`` is a fitted pipeline, without one the fixed scorer is used."""
    rows = scoring.features(scoring.attributes(pairs, norm))
    scores = training.predict(model, rows) if model is not None else scoring.score_logit(rows)
    return scoring.match_output(norm, matches(scores, settings.threshold, settings.per_source))


def run(spark: SparkSession, settings: Settings, model=None, name: str | None = None) -> str:
    """Files to files; returns the run's folder, a new one under ``settings.output_dir``.

    Reads source1.tsv, source2.tsv and source3.tsv, which must be there with
    the entity columns.  Writes candidates, matches, a copy of the matches and a report
    (pairs, seconds, pairs a second, and whether the matches are complete).
    """
    paths = [f"{settings.input_dir}/source{i}.tsv" for i in SOURCES]
    tables.require(spark, paths, tables.ENTITY)
    out, began = f"{settings.output_dir}/{name or run_id()}", time.time()
    read = [tables.read_entities(spark, p).withColumn("source", F.lit(i)) for i, p in zip(SOURCES, paths, strict=True)]
    norm = blocking.normalized(blocking.dedupe(read[0].unionByName(read[1]).unionByName(read[2]))).persist()
    pairs = blocking.candidates(norm, settings.passes, settings.block_cap).persist()
    try:
        tables.write_tsv(blocking.widen(norm, pairs).orderBy("source1_entity_id"), f"{out}/candidates")
        n_pairs, blocked = pairs.count(), time.time()
        log.info("%s candidate pairs after %.1f s", n_pairs, blocked - began)
        tables.write_tsv(decide(norm, pairs, settings, model).orderBy("source1_entity_id"), f"{out}/matches")
        took = time.time() - blocked
        log.info("scored in %.1f s, %.0f pairs a second", took, n_pairs / max(took, 1e-9))
        tables.write_tsv(tables.read_tsv(spark, f"{out}/matches", tables.MATCHES).orderBy("source1_entity_id"), f"{out}/matches-copy")
        tables.require(spark, [f"{out}/candidates"], tables.CANDIDATES, exact=True)
        tables.require(spark, [f"{out}/matches"], tables.MATCHES, exact=True)
        result = tables.read_tsv(spark, f"{out}/matches", tables.MATCHES).na.fill("")
        report = evaluate.output_audit(result, norm.filter("source = 1")).withColumns({"pairs": F.lit(n_pairs), "seconds": F.lit(round(took, 3)), "pairs_per_second": F.lit(round(n_pairs / max(took, 1e-9), 1))})
        tables.write_report(report, f"{out}/report")
    finally:
        pairs.unpersist()
        norm.unpersist()
    return out


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    print(run(SparkSession.builder.getOrCreate(), Settings.from_env()))
