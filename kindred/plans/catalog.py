"""The registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import blocking, evaluate, scoring, training
from kindred.sources import fixture

from . import matcher
from . import sql as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = sql


_norm = matcher.normalized
_truth = fixture.truth


def _pairs(spark, sf):
    return blocking.candidates(_norm(spark, sf))


def _scored(spark, sf):
    return matcher.scored(_norm(spark, sf))


def _judged(spark, sf):
    """``_scored`` with is_true; neither the pairs nor their scores are moved."""
    return scoring.score_logit(scoring.features(scoring.met(_norm(spark, sf), _truth(spark, sf))))


def _found(spark, sf):
    """The true pairs that are candidates."""
    return blocking.among(_truth(spark, sf), _norm(spark, sf))


def _keys(spark, sf, passes=blocking.PASSES):
    n = _norm(spark, sf)
    return blocking.keys(n.filter("source = 1"), passes), blocking.keys(n.filter("source <> 1"), passes)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- scalar functions and keys
_add("normalize_text", lambda s, d: _norm(s, d).select("entity_id", "name_norm", "addr_norm"), S.norm("SELECT entity_id, name_norm, addr_norm FROM norm"))
_add("normalize_country", lambda s, d: _norm(s, d).select("entity_id", "country_norm"), S.norm("SELECT entity_id, country_norm FROM norm"))
_add("normalize_text_unicode", lambda s, d: fixture.entities(s, d).select("entity_id", text.normalize_unicode("business_name").alias("name_unicode")))
_add("strip_legal", lambda s, d: _norm(s, d).select("entity_id", text.strip_legal(F.concat("name_norm", F.lit(" pvt ltd co"))).alias("clean")), S.norm(f"SELECT entity_id, {S.clean("name_norm || ' pvt ltd co'")} AS clean FROM norm"))
_add("derive_block_keys", lambda s, d: _norm(s, d).select("entity_id", "prefix6", "first_token"), S.norm("SELECT entity_id, prefix6, first_token FROM norm"))
_add("target_pool", lambda s, d: fixture.entities(s, d).filter("source = 2").unionByName(fixture.entities(s, d).filter("source = 3")), S.norm("SELECT entity_id, source, business_name, business_address, country FROM ent WHERE source = 2 UNION ALL SELECT entity_id, source, business_name, business_address, country FROM ent WHERE source = 3"))
_add("postal_tokens", lambda s, d: blocking.keys(_norm(s, d), ("postal",)).select("entity_id", "country", "key"), S.keys("SELECT entity_id, country, key FROM keys WHERE pass = 'postal'"))

# --- blocks, passes and candidates
for _p in blocking.PASSES:
    _add(f"allowed_blocks_{_p}", lambda s, d, p=_p: blocking.allowed(_keys(s, d, (p,))[1]).drop("pass"), S.keys(f"SELECT country, key, n FROM allowed WHERE pass = '{_p}'"))
for _p in blocking.PASSES + blocking.EXTRA_PASSES:
    _name = f"pass_{_p}" if _p in blocking.PASSES else {"house_addr_token": "house_number_pass", "name_addr_token": "name_addr_token_pass", "rare_name_token": "rare_name_token_pass", "rare_addr_token": "rare_addr_token_pass", "addr_tail": "addr_tail_pass"}.get(_p, _p)
    _add(_name, lambda s, d, p=_p: blocking.pairs_by_pass(*_keys(s, d, (p,))).select("s1_id", "cand_id"), S.keys(f"SELECT s1_id, cand_id FROM by_pass WHERE pass = '{_p}'"))
_add("allowed_blocks_small_cap", lambda s, d: blocking.allowed(_keys(s, d, ("first_token",))[1], 5).drop("pass"), S.keys("SELECT country, key, count(*) AS n FROM tkeys WHERE pass = 'first_token' GROUP BY ALL HAVING count(*) <= 5"))
_add("per_source_passes", lambda s, d: blocking.pairs_by_pass(*_keys(s, d)).withColumn("target", scoring.source_of(F.col("cand_id"))).groupBy("pass", "target").agg(F.count("*").alias("pairs")), S.keys(f"SELECT pass, split_part(cand_id, '-', 1) AS target, count(*) AS pairs FROM by_pass WHERE pass IN {S.FOUR} GROUP BY ALL"))
_add("candidate_union", _pairs, S.keys("SELECT s1_id, cand_id FROM cand"))
_add("candidate_wide", lambda s, d: blocking.widen(_norm(s, d), _pairs(s, d)), S.keys("SELECT n.entity_id AS source1_entity_id, coalesce(string_agg(c.cand_id, ',' ORDER BY c.cand_id), '') AS candidate_entity_ids FROM norm n LEFT JOIN cand c ON n.entity_id = c.s1_id WHERE n.source = 1 GROUP BY n.entity_id"))


def _unnest(s, d):
    from kindred.sources.tables import unnest

    return unnest(blocking.widen(_norm(s, d), _pairs(s, d)), "candidate_entity_ids", "candidate_entity_id")


_add("unnest_candidates", _unnest, S.keys("SELECT s1_id AS source1_entity_id, cand_id AS candidate_entity_id FROM cand"))
_add("candidate_stats", lambda s, d: blocking.stats(_norm(s, d), _pairs(s, d)), S.keys("SELECT CAST(sum(k) AS BIGINT) AS candidate_pairs, avg(k) AS mean_candidates, max(k) AS max_candidates FROM (SELECT n.entity_id, count(c.cand_id) AS k FROM norm n LEFT JOIN cand c ON n.entity_id = c.s1_id WHERE n.source = 1 GROUP BY n.entity_id)"))
_add("blocking_pass_gain", lambda s, d: blocking.pass_gain(blocking.met(_norm(s, d), _truth(s, d))), S.keys(S.PASS_GAIN))
_add("blocking_miss_diagnosis", lambda s, d: blocking.missed(_truth(s, d), _found(s, d), *_keys(s, d)), S.keys(S.MISSED))

_add("miss_shared_tokens", lambda s, d: blocking.missed_overlaps(_truth(s, d), _found(s, d), _norm(s, d)), S.keys(S.MISSED_OVERLAPS))
_add("per_source_caps", lambda s, d: blocking.pairs_by_source(_norm(s, d)), S.keys(S.PER_SOURCE_CAPS))
_add("selective_6_pass", lambda s, d: blocking.selective_pairs(_norm(s, d)).select("s1_id", "cand_id").distinct(), S.selective(f"SELECT DISTINCT s1_id, cand_id FROM chosen WHERE pass IN {blocking.SELECTIVE_PASSES}", blocking.GENERIC, blocking.PER_ENTITY))
# lower limits, so that both bind on small tables
_add("selective_token_passes", lambda s, d: blocking.selective_pairs(_norm(s, d), blocking.TOKEN_PASSES, most=20, per_entity=5), S.selective(f"SELECT pass, s1_id, cand_id FROM chosen WHERE pass IN {blocking.TOKEN_PASSES}", 20, 5))
_add("generic_tokens", lambda s, d: blocking.generic_tokens(_keys(s, d, ("rare_name_token", "rare_addr_token"))[1], 20), S.selective("SELECT country, token FROM generic", 20, 5))

# --- attributes, features, scores
_add("pair_attributes", lambda s, d: scoring.attributes(_pairs(s, d), _norm(s, d)), S.feats("SELECT s1_id, cand_id, s1_name, s1_addr, s1_country, c_name, c_addr, c_country FROM attrs"))
for _n, _f in (("sim_ratio", "name_ratio"), ("sim_token_sort", "name_token_sort"), ("sim_token_set", "name_token_set"), ("sim_clean_name", "clean_name_ratio"), ("number_match", "number_match_score"), ("country_match", "country_match")):
    _add(_n, lambda s, d, f=_f: scoring.features(scoring.attributes(_pairs(s, d), _norm(s, d)), ["clean_name_ratio", f] if f == "country_match" else [f]).select("s1_id", "cand_id", (F.col(f) if f == "country_match" else F.round(f, 6)).alias(f)), S.feats(f"SELECT s1_id, cand_id, {_f if _f == 'country_match' else f'round({_f}, 6) AS {_f}'} FROM feats"))
_add("length_diffs", lambda s, d: scoring.features(scoring.attributes(_pairs(s, d), _norm(s, d)), ["name_length_diff", "address_length_diff"]).select("s1_id", "cand_id", "name_length_diff", "address_length_diff"), S.feats("SELECT s1_id, cand_id, name_length_diff, address_length_diff FROM feats"))
_FLOATS = [c for c in scoring.FEATURES_11 if "diff" not in c and c != "country_match"]
_sql11 = ", ".join(f"round({c}, 6) AS {c}" if c in _FLOATS else c for c in scoring.FEATURES_11)
_sql9 = ", ".join(f"round({c}, 6) AS {c}" if c in _FLOATS else c for c in scoring.FEATURES_9).replace("country_match", "1 AS country_match")
_add("features_11", lambda s, d: _rounded(_scored(s, d), *_FLOATS).select("s1_id", "cand_id", *scoring.FEATURES_11), S.feats(f"SELECT s1_id, cand_id, {_sql11} FROM feats"))
_add("features_9", lambda s, d: _rounded(scoring.features(scoring.attributes(_pairs(s, d), _norm(s, d)), scoring.FEATURES_9), *(c for c in _FLOATS if c in scoring.FEATURES_9)).select("s1_id", "cand_id", *scoring.FEATURES_9), S.feats(f"SELECT s1_id, cand_id, {_sql9} FROM feats"))
_add("score_fixed_logit", lambda s, d: _rounded(_scored(s, d), "prob").select("s1_id", "cand_id", "prob"), S.feats("SELECT s1_id, cand_id, round(prob, 6) AS prob FROM scored"))
_add("disambiguation_filter", lambda s, d: scoring.disambiguated(_scored(s, d)).select("s1_id", "cand_id"), S.feats("SELECT s1_id, cand_id FROM clear"))
_add("threshold_matches", lambda s, d: scoring.at_least(scoring.disambiguated(_scored(s, d))).select("s1_id", "cand_id"), S.feats("SELECT s1_id, cand_id FROM clear WHERE prob >= 0.9"))
for _k, _n in ((1, "top1_per_source"), (2, "top2_per_source"), (3, "cap3_per_source")):
    _add(_n, lambda s, d, k=_k: scoring.top_per_source(scoring.at_least(scoring.disambiguated(_rounded(_scored(s, d), "prob"))), k).select("s1_id", "cand_id", "target", "rank"), S.feats(f"SELECT s1_id, cand_id, target, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= {_k}"))
_add("match_output", lambda s, d: scoring.match_output(_norm(s, d), scoring.top_per_source(scoring.at_least(scoring.disambiguated(_rounded(_scored(s, d), "prob"))), 3)), S.feats("SELECT n.entity_id AS source1_entity_id, coalesce(string_agg(r.cand_id, ',' ORDER BY r.target, r.rank), '') AS matched_entity_ids FROM norm n LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) r ON n.entity_id = r.s1_id WHERE n.source = 1 GROUP BY n.entity_id"))

# --- training
_add("split_validation", lambda s, d: training.split(fixture.entities(s, d).filter("source = 1"), 100), S.norm("SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY md5(entity_id || '42'), entity_id) <= 100 THEN 'validation' ELSE 'train' END AS split FROM ent WHERE source = 1"))
_add("positives", lambda s, d: training.positives(_norm(s, d), _truth(s, d)), S.train("SELECT * FROM training WHERE label = 1"))
for _k, _n in (("name_confusion", "neg_name"), ("prefix_confusion", "neg_prefix"), ("token_confusion", "neg_token")):
    _add(_n, lambda s, d, k=_k: training.negatives(_norm(s, d), _truth(s, d), k), S.mined(f"SELECT * FROM training WHERE pair_type = '{_k}'"))
_add("training_set", lambda s, d: training.training_set(_norm(s, d), _truth(s, d)), S.mined("SELECT * FROM training"))
_add("idf_shortlist", lambda s, d: training.idf_shortlist(_norm(s, d)).select("s1_id", "cand_id", "weight"), S.norm(S.IDF))
_add("ratio_sample", lambda s, d: training.ratio_sample(training.training_set(_norm(s, d), _truth(s, d)), 2).select("s1_id", "cand_id", "label", "pair_type"), S.mined("SELECT s1_id, cand_id, label, pair_type FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(s1_id || cand_id || pair_type || '42'), s1_id, cand_id, pair_type) AS rn FROM training) WHERE label = 1 OR rn <= 2 * (SELECT count(*) FROM training WHERE label = 1)"))
_add("ratio_sweep", lambda s, d: training.ratio_sweep(training.training_set(_norm(s, d), _truth(s, d), sides=training.SIDES)), S.train(S.RATIO_SWEEP))
_add("random_negatives", lambda s, d: training.random_negatives(_norm(s, d), _truth(s, d)), S.keys(S.RANDOM_NEGATIVES))
_tenants = lambda s, d: blocking.normalized(fixture.tenants(s, d))
_add("neg_same_addr", lambda s, d: training.negatives(_tenants(s, d), _truth(s, d), "same_addr_confusion"), S.tenants("SELECT * FROM training WHERE pair_type = 'same_addr_confusion'", S.MINED))
_add("neg_country", lambda s, d: training.country_confusion(_tenants(s, d), _truth(s, d)), S.tenants(S.COUNTRY))
_add("confusion_categories", lambda s, d: training.confusion_examples(_judged(s, d), _truth(s, d)), S.feats(S.CONFUSION))
_add("class_weights", lambda s, d: training.class_weights(training.training_set(_norm(s, d), _truth(s, d))).select("label", F.round("weight", 9).alias("weight")), S.mined("SELECT label, round(CAST((SELECT count(*) FROM training) AS DOUBLE) / (2.0 * count(*)), 9) AS weight FROM training GROUP BY label"))


def _model_score(kind, **params):
    def query(s, d):
        norm = _norm(s, d)
        rows = training.training_set(norm, _truth(s, d), training.LIMITS, training.SIDES).drop("pair_type")
        model = training.fit(scoring.features(rows).persist(), kind, **params)
        return training.predict(model, scoring.features(scoring.met(norm))).select("s1_id", "cand_id", F.round("prob", 6).alias("prob"))

    return query


_add("rf_score", _model_score("rf"))
_add("gbt_score", _model_score("gbt"))

# --- evaluation
_add("candidate_recall", lambda s, d: evaluate.candidate_recall(_found(s, d), _truth(s, d)), S.feats("SELECT count(*) AS true_pairs, count(c.cand_id) AS found, round(count(c.cand_id) / CAST(count(*) AS DOUBLE), 9) AS recall FROM truth t LEFT JOIN cand c USING (s1_id, cand_id)"))
_add("threshold_sweep", lambda s, d: evaluate.sweep(_rounded(_judged(s, d), "prob"), _truth(s, d)), S.feats(S.sweep(evaluate.THRESHOLDS)))
_add("best_threshold", lambda s, d: evaluate.best_threshold(evaluate.sweep(_rounded(_judged(s, d), "prob"), _truth(s, d))), S.feats(f"SELECT threshold, end_to_end_f_half FROM ({S.sweep(evaluate.THRESHOLDS)}) ORDER BY end_to_end_f_half DESC, threshold LIMIT 1"))
_add("macro_f05", lambda s, d: evaluate.macro_f_half(fixture.entities(s, d).filter("source = 1"), _truth(s, d), scoring.at_least(scoring.disambiguated(_judged(s, d)))), S.feats(S.MACRO))
def _macro(s, d):
    best = scoring.top_per_source(scoring.at_least(scoring.disambiguated(_rounded(_judged(s, d), "prob")), min(evaluate.MACRO_THRESHOLDS)), 3)
    return evaluate.macro_sweep(fixture.entities(s, d).filter("source = 1"), _truth(s, d), best)


_add("macro_sweep", _macro, S.feats(S.macro_sweep(evaluate.MACRO_THRESHOLDS) + " SELECT * FROM swept"))
_add("best_macro_threshold", lambda s, d: evaluate.best_threshold(_macro(s, d), "macro_f_half"), S.feats(S.macro_sweep(evaluate.MACRO_THRESHOLDS) + " SELECT threshold, macro_f_half FROM swept ORDER BY macro_f_half DESC, threshold LIMIT 1"))
def _breakdown(s, d):
    norm, found = _norm(s, d), _found(s, d)
    scored = scoring.score_logit(scoring.features(scoring.attributes(found, norm)))  # false pairs count nowhere
    return evaluate.fn_breakdown(scored, found, _truth(s, d), 0.9)


_add("fn_breakdown", lambda s, d: _breakdown(s, d), S.feats("SELECT CASE WHEN c.cand_id IS NULL THEN 'blocking_miss' WHEN s.cand_id IS NULL THEN 'model_miss' ELSE 'found' END AS kind, count(*) AS n FROM truth t LEFT JOIN cand c USING (s1_id, cand_id) LEFT JOIN (SELECT * FROM scored WHERE prob >= 0.9) s USING (s1_id, cand_id) GROUP BY 1"))
_add("error_taxonomy", lambda s, d: evaluate.error_taxonomy(_judged(s, d), _found(s, d), _truth(s, d), 0.9), S.feats("SELECT s1_id, cand_id, 'A' AS error FROM truth ANTI JOIN cand USING (s1_id, cand_id) UNION ALL SELECT s1_id, cand_id, 'B' FROM scored SEMI JOIN truth USING (s1_id, cand_id) WHERE prob < 0.9 UNION ALL SELECT s1_id, cand_id, 'C' FROM scored ANTI JOIN truth USING (s1_id, cand_id) WHERE prob >= 0.9"))
_add("similarity_quantiles", lambda s, d: evaluate.quantiles(_rounded(_scored(s, d), "name_ratio"), "name_ratio"), S.feats("SELECT " + ", ".join(f"round(quantile_cont(r, {p}), 6) AS q{int(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)) + ", round(avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share_080 FROM (SELECT round(name_ratio, 6) AS r FROM feats)"))
_add("label_audit", lambda s, d: evaluate.label_audit(training.training_set(_norm(s, d), _truth(s, d), sides=training.SIDES), training.split(fixture.entities(s, d).filter("source = 1"), 100)), S.train("SELECT 'repeated_pairs' AS \"check\", count(*) AS n FROM (SELECT 1 FROM training GROUP BY s1_id, cand_id, pair_type HAVING count(*) > 1) UNION ALL SELECT 'both_labels', count(*) FROM (SELECT 1 FROM training GROUP BY s1_id, cand_id HAVING count(DISTINCT label) > 1) UNION ALL SELECT 'both_splits', 0"))
_add("target_leakage", lambda s, d: evaluate.target_leakage(_truth(s, d), training.split(fixture.entities(s, d).filter("source = 1"), 100)), S.keys(S.LEAKAGE))
_add("output_audit", lambda s, d: evaluate.output_audit(QUERIES["match_output"](s, d), fixture.entities(s, d).filter("source = 1")), S.feats("SELECT count(*) AS rows, count(*) AS entities, count(*) FILTER (WHERE k > 0) AS with_matches, count(*) AS expected, true AS complete FROM (SELECT n.entity_id, count(r.cand_id) AS k FROM norm n LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) r ON n.entity_id = r.s1_id WHERE n.source = 1 GROUP BY n.entity_id)"))

# --- relational odds and ends
_add("page_offset", lambda s, d: fixture.entities(s, d).filter("source = 1").select("entity_id").orderBy("entity_id").offset(10).limit(20), S.norm("SELECT entity_id FROM ent WHERE source = 1 ORDER BY entity_id LIMIT 20 OFFSET 10"))
_add("star_minus", lambda s, d: fixture.entities(s, d).drop("business_address"), S.norm("SELECT * EXCLUDE (business_address) FROM ent"))
_add("semi_in", lambda s, d: fixture.entities(s, d).filter("source = 1").join(_pairs(s, d).select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id"), S.keys("SELECT entity_id FROM ent WHERE source = 1 AND entity_id IN (SELECT s1_id FROM cand)"))
_add("dedupe_entity", lambda s, d: blocking.dedupe(fixture.entities(s, d).unionByName(fixture.entities(s, d))).select("entity_id", "country"), S.norm("SELECT entity_id, country FROM ent"))
