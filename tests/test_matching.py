import dataclasses
import glob
import json

import duckdb
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from kindred import streaming
from kindred.functions import text
from kindred.operators import blocking, evaluate, scoring, training
from kindred.plans import catalog, matcher
from kindred.plans import sql as S
from kindred.sources import tables
from kindred.sources.config import Settings


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Oswal & Có", "oswal c"), ("डिजिटल सॉफ्टवेयर", ""), ("  A.B.C\tLtd ", "a b c ltd"), ("##11, BOMBAY", "11 bombay"), (None, "")],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize) == want


def test_unicode_and_legal(spark):
    assert one(spark, "Có, ﬁ!", text.normalize_unicode) == "có  fi "
    assert one(spark, None, text.normalize_unicode) == ""
    assert one(spark, "acme pvt ltd holdings", text.strip_legal) == "acme"
    assert one(spark, "k p 14 173a 5th 32", text.numbers) == ["14", "32"]


@pytest.mark.parametrize(("a", "b", "want"), [("14", "15", -1), ("14 2", "14", 1), ("", "14", 0)])
def test_number_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.number_match(F.col("a"), F.col("b"))).first()[0] == want


def entities(spark, rows):
    return blocking.normalized(spark.createDataFrame(rows, "entity_id string, source int, business_name string, business_address string, country string"))


def test_blocks_are_kept_or_suppressed_whole(spark):
    for n, found in ((250, 250), (251, 0)):
        rows = [("S1-1", 1, "Acme", None, "de")] + [(f"S2-{i}", 2, "acme", "", "DE") for i in range(n)]
        assert blocking.candidates(entities(spark, rows), ("exact",)).count() == found


def test_keys(spark):
    norm = entities(spark, [("S2-1", 2, "ab", "12345 1234567", None)])
    got = {(r["pass"], r["key"]) for r in blocking.keys(norm).collect()}
    assert got == {("exact", "ab"), ("postal", "12345")}


def test_wide_order_and_blank_row(spark):
    norm = entities(spark, [("S1-1", 1, "a", "", ""), ("S1-2", 1, "b", "", "")])
    pairs = spark.createDataFrame([("S1-1", c) for c in ("S3-1", "S2-9", "S2-10", "S2-9")], "s1_id string, cand_id string")
    assert {tuple(r) for r in blocking.widen(norm, pairs).collect()} == {("S1-1", "S2-10,S2-9,S3-1"), ("S1-2", "")}


def test_cap_three(spark):
    rows = [("S1-1", f"S2-{i}", 0.9) for i in (4, 3, 2, 1)] + [("S1-1", "S3-1", 0.95), ("S1-1", "S9-1", 0.99)]
    capped = scoring.top_per_source(spark.createDataFrame(rows, "s1_id string, cand_id string, prob double"), 3)
    norm = entities(spark, [("S1-1", 1, "a", "", ""), ("S1-2", 1, "b", "", "")])
    assert {tuple(r) for r in scoring.match_output(norm, capped).collect()} == {("S1-1", "S2-1,S2-2,S2-3,S3-1"), ("S1-2", "")}


def test_macro(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    truth = spark.createDataFrame([("S1-3", "S2-1"), ("S1-3", "S2-2")], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("S1-2", "S2-1"), ("S1-3", "S2-1")], "s1_id string, cand_id string")
    row = evaluate.macro_f_half(s1, truth, pred).first()
    assert row["no_match_count"] == 1
    assert row["macro_f_half"] == pytest.approx((1 + 0 + 1.25 * 0.5 / (0.25 + 0.5)) / 3, abs=1e-8)


def test_published_formula(spark):
    # threshold 0.975 of a published sweep: precision, end-to-end recall, F0.5
    got = spark.range(1).select(evaluate.f_half(F.lit(0.991965), F.lit(0.828370))).first()[0]
    assert got == pytest.approx(0.954273, abs=2e-6)


def test_tsv_bytes(spark, tmp_path):
    src = tmp_path / "in.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Acme ""X"" Ltd"\t\tde\n')
    row = tables.read_entities(spark, str(src)).first()
    assert row["business_name"] == 'Acme "X" Ltd'
    out = str(tmp_path / "out")
    tables.write_tsv(spark.createDataFrame([("S1-1", "")], "source1_entity_id string, matched_entity_ids string"), out, single_file=True)
    assert open(glob.glob(out + "/part-*")[0]).read() == "source1_entity_id\tmatched_entity_ids\nS1-1\t\n"
    wide = spark.createDataFrame([("S1-1", "a,, b")], tables.CANDIDATES)
    assert {r[1] for r in tables.unnest(wide, "candidate_entity_ids", "c").collect()} == {"a", "b"}


def test_readers(spark, tmp_path):
    src = tmp_path / "in.tsv"
    src.write_text("country\textra\tbusiness_name\tentity_id\tbusiness_address\nde\tx\tAcme\tS1-1\t\n")
    assert tuple(tables.read_entities(spark, str(src)).first()) == ("S1-1", "Acme", None, "de")  # columns are found by name
    lines = tmp_path / "lines.tsv"
    lines.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\n\n   \nS1-2\t\n")
    assert [tuple(r) for r in tables.read_lines(spark, str(lines)).collect()] == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    truth = tables.unnest(tables.read_tsv(spark, str(lines), tables.TRUTH), "matched_entity_ids", "target")
    assert {tuple(r) for r in truth.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    ids = spark.createDataFrame([("S1-2",), ("S1-2",), (None,)], "source1_entity_id string")
    assert [r[0] for r in tables.only_ids(tables.read_tsv(spark, str(lines), tables.TRUTH), ids, "source1_entity_id").collect()] == ["S1-2"]


def test_registered_frame(spark):
    tables.register(spark, [("S1-1", None)], "people", "entity_id string, country string")
    assert [tuple(r) for r in spark.sql("SELECT entity_id, coalesce(country, '') FROM people").collect()] == [("S1-1", "")]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, 3), (0.6, 2)], "threshold double, n int")
    tables.write_report(rows, str(tmp_path / "r"))
    assert [json.loads(x) for x in open(glob.glob(str(tmp_path / "r/part-*"))[0])] == [{"threshold": 0.5, "n": 3}, {"threshold": 0.6, "n": 2}]
    assert tables.render_report(rows).split() == ["threshold", "n", "0.5", "3", "0.6", "2"]
    with pytest.raises(ValueError, match="more than 1"):
        tables.render_report(rows, 1)


def tsv(path, rows):
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))


def inputs(folder):
    tsv(folder / "source1.tsv", [("S1-2", "Oswal & Co", "2/209 6Th Street, Madurai 625001", "india"), ("S1-1", "Forge Works", "746 Lafayette Avenue, Buffalo", "us"), ("S1-3", "Nobody", "", "us")])
    tsv(folder / "source2.tsv", [(f"S2-{i}", "Oswal Co", "2/209 6th street Madurai 625001", "India") for i in range(5)] + [("S2-9", "Oswal Motors", "99 Ring Road, Delhi 110001", "india")])
    tsv(folder / "source3.tsv", [("S3-7", "Forge Works LLC", "746 Lafayette Ave Buffalo", "US"), ("S3-7", "Forge", "", "US")])


def test_files_to_files(spark, tmp_path):
    inputs(tmp_path)
    settings = Settings(input_dir=str(tmp_path), output_dir=str(tmp_path / "out"), threshold=0.5)
    out = matcher.run(spark, settings)
    body = lambda name: [x for f in sorted(glob.glob(f"{out}/{name}/part-*")) for x in open(f).read().splitlines()]
    rows = [x.split("\t") for x in body("matches") if not x.startswith("source1_entity_id")]
    assert [r[0] for r in rows] == ["S1-1", "S1-2", "S1-3"]  # one row each, in order
    found = dict(rows)
    assert found["S1-3"] == "" and found["S1-2"] == "S2-0,S2-1,S2-2"  # three of a source, ties by id; the other name and address are not matched
    assert body("matches-copy") and dict(x.split("\t") for x in body("matches-copy")) | {} == dict(x.split("\t") for x in body("matches"))
    assert "S1-2\tS2-0,S2-1,S2-2,S2-3,S2-4,S2-9" in body("candidates")
    report = json.loads(body("report")[0])
    assert report["complete"] and report["rows"] == 3 and report["pairs"] >= 7 and report["pairs_per_second"] > 0
    assert matcher.run(spark, settings) != out  # a run never writes over another
    with pytest.raises(FileNotFoundError):
        matcher.run(spark, dataclasses.replace(settings, input_dir=str(tmp_path / "none")))
    (tmp_path / "source3.tsv").write_text("id\tname\nS3-1\tx\n")
    with pytest.raises(ValueError, match="columns"):
        matcher.run(spark, settings)


def test_stream(spark, tmp_path):
    inputs(tmp_path)
    targets = blocking.normalized(tables.read_entities(spark, str(tmp_path / "source2.tsv")).withColumn("source", F.lit(2)).unionByName(tables.read_entities(spark, str(tmp_path / "source3.tsv")).withColumn("source", F.lit(3))))
    (tmp_path / "stream").mkdir()
    (tmp_path / "source1.tsv").rename(tmp_path / "stream" / "a.tsv")
    settings = Settings(threshold=0.5)
    for rows in (None, [("S1-8", "Oswal Co", "2/209 6th street Madurai 625001", "INDIA")]):
        if rows:
            tsv(tmp_path / "stream" / "b.tsv", rows)
        stream = spark.readStream.schema(tables.ENTITY).option("sep", "\t").option("header", True).csv(str(tmp_path / "stream"))
        streaming.match_stream(stream, targets, str(tmp_path / "found"), str(tmp_path / "checkpoint"), settings).awaitTermination()
    found = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "found")).collect()}
    assert found["S1-2"] == found["S1-8"] == "S2-0,S2-1,S2-2" and set(found) == {"S1-1", "S1-2", "S1-3", "S1-8"}
    assert len(glob.glob(str(tmp_path / "found/batch=*"))) == 2


def test_selective_blocking(spark):
    rows = [("S1-1", 1, "alpha works", "12 main street", "de")]
    rows += [(f"S2-{i}", 2, "alpha works", f"{12 if i < 3 else 99} main street", "de") for i in range(8)] + [("S3-1", 3, "beta works", "12 main road", "de")]
    norm = entities(spark, rows)
    got = lambda *a, **k: {(r["pass"], r["cand_id"]) for r in blocking.selective_pairs(norm, *a, **k).collect()}
    assert {c for p, c in got(("house_addr_token",), most=100)} == {"S2-0", "S2-1", "S2-2", "S3-1"}
    assert got(("house_addr_token",), most=8) == {("house_addr_token", f"S2-{i}") for i in range(3)}  # "main" is in 9 targets, "street" in 8
    assert got(("house_addr_token",), most=7) == set()  # both are generic
    assert len(got(("name_addr_token",), most=100, per_entity=2)) == 2
    # the least blocks first: S3-1 shares the rarer token
    assert got(("rare_addr_token",), most=100, per_entity=2) == {("rare_addr_token", "S2-0"), ("rare_addr_token", "S2-1")}
    assert len(got(("exact",), most=1, per_entity=1)) == 8  # the plain passes have no such limits


def test_caps_by_source(spark):
    rows = [("S1-1", 1, "acme", None, "de")] + [(f"S2-{i}", 2, "acme", "", "DE") for i in range(4)] + [("S3-1", 3, "acme", "", "DE")]
    assert {tuple(r) for r in blocking.pairs_by_source(entities(spark, rows), ("exact",), 3).collect()} == {("exact", "S3", "S1-1", "S3-1")}
    assert blocking.candidates(entities(spark, rows), ("exact",), 3).count() == 0  # together they are over the cap


def test_country_confusion(spark):
    rows = [("S1-1", 1, "alpha shop", "a", "de"), ("S2-1", 2, "alpha shop", "b", "fr"), ("S2-2", 2, "alpha shop", "c", "de"), ("S3-1", 3, "alpha shop", "a", "fr"), ("S1-2", 1, "abc", "", "de"), ("S2-3", 2, "abc", "", "fr")]
    truth = spark.createDataFrame([("S1-1", "S3-1")], "s1_id string, cand_id string")
    assert [tuple(r) for r in training.country_confusion(entities(spark, rows), truth).collect()] == [("S1-1", "S2-1")]
    assert training.country_confusion(entities(spark, rows), truth, 2).count() == 0


def test_same_address_negatives(spark):
    rows = [("S1-1", 1, "alpha shop", "1 plaza road town", "de"), ("S2-1", 2, "beta store", "1 plaza road town", "de"), ("S2-2", 2, "alpha store", "1 plaza road town", "de"), ("S2-3", 2, "", "1 plaza road town", "de"), ("S3-1", 3, "gamma", "1 plaza road town", "de")]
    truth = spark.createDataFrame([("S1-1", "S3-1")], "s1_id string, cand_id string")
    got = training.negatives(entities(spark, rows), truth, "same_addr_confusion").collect()
    assert [(r["cand_id"], r["label"], r["pair_type"]) for r in got] == [("S2-1", 0, "same_addr_confusion")]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 501])
def test_hashed_limit(spark, n):
    import hashlib

    df = spark.range(500).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("k"))
    order = sorted((r[0] for r in df.collect()), key=lambda k: (hashlib.md5((k + "42").encode()).hexdigest(), k))
    assert sorted(r[0] for r in training.hashed_limit(df, n, "k").collect()) == sorted(order[:n])
    assert df.count() == training.hashed_share(df, 500, "k").count() and 20 < training.hashed_share(df, 50, "k").count() < 90


def test_macro_sweep(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, cand_id string")
    ranked = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-3", 0.7), ("S1-2", "S2-1", 0.65)], "s1_id string, cand_id string, prob double")
    got = {r["threshold"]: r for r in evaluate.macro_sweep(s1, truth, ranked, [0.6, 0.7, 0.95]).collect()}
    half = 1.25 * 0.5 * 0.5 / (0.25 * 0.5 + 0.5)
    assert got[0.6]["macro_f_half"] == pytest.approx((half + 0 + 1) / 3, abs=1e-8) and got[0.6]["no_match_count"] == 1 and got[0.6]["false_positives"] == 2
    assert got[0.7]["macro_f_half"] == pytest.approx((half + 1 + 1) / 3, abs=1e-8) and got[0.7]["precision"] == got[0.7]["recall"] == 0.5
    assert got[0.95]["macro_f_half"] == pytest.approx(2 / 3, abs=1e-8) and got[0.95]["predictions"] == 0 and got[0.95]["micro_f_half"] == 0
    assert evaluate.best_threshold(spark.createDataFrame([(0.7, 0.5), (0.6, 0.5), (0.8, 0.4)], "threshold double, macro_f_half double"), "macro_f_half").first()[0] == 0.6


def test_guardrails():
    before = {"recall": 0.7, "f_half": 0.9, "pairs": 100}
    assert evaluate.guardrails(before, {"recall": 0.8, "f_half": 0.86, "pairs": 300})
    assert not evaluate.guardrails(before, {"recall": 0.7, "f_half": 0.9, "pairs": 100})
    assert not evaluate.guardrails(before, {"recall": 0.8, "f_half": 0.85, "pairs": 100})
    assert not evaluate.guardrails(before, {"recall": 0.8, "f_half": 0.9, "pairs": 301})


@pytest.mark.parametrize(("kind", "params"), [("gbt", {"maxIter": 5}), ("rf", {"numTrees": 20, "maxDepth": 6})])
def test_models(spark, tmp_path, kind, params):
    rows = [(i, float(i % 2), 0.9 - 0.5 * (i % 2 == 0) + 0.01 * (i % 7), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label double, name_ratio double, country_match int")
    columns = ["name_ratio", "country_match"]
    model = training.fit(df, kind, columns, **params)
    probs = {r["id"]: r["prob"] for r in training.predict(model, df).collect()}
    assert all((probs[i] > 0.5) == bool(i % 2) for i in probs)
    tables.save_model(model, str(tmp_path / "m"), columns, 0.7)
    again, features, threshold = tables.load_model(spark, str(tmp_path / "m"))
    assert (features, threshold) == (columns, 0.7)
    assert {r["id"]: r["prob"] for r in training.predict(again, df).collect()} == probs


def test_fitted_models_beat_the_fixed_scorer(spark):
    norm, truth = catalog._norm(spark, "/root/testdata/sf0.1"), catalog._truth(spark, "/root/testdata/sf0.1")
    rows = scoring.score_logit(scoring.features(training.training_set(norm, truth, 600))).withColumn("held", F.xxhash64("s1_id") % 3 == 0).persist()
    auc = lambda df: BinaryClassificationEvaluator(rawPredictionCol="prob").evaluate(df)
    fixed = auc(rows.filter("held"))
    model = training.fit(rows.filter("not held").drop("prob"), "rf", numTrees=10, maxDepth=7)
    assert auc(training.predict(model, rows.filter("held").drop("prob"))) > fixed
    rows.unpersist()


def test_scores_are_fitted_on_the_whole_set_with_the_defaults(spark, monkeypatch):
    seen = []

    def stop(rows, kind, **params):
        seen.append((rows.count(), kind, params))
        raise StopIteration

    sf = "/root/testdata/sf0.01"
    whole = training.training_set(catalog._norm(spark, sf), catalog._truth(spark, sf), training.LIMITS)
    kinds = {r[0]: r[1] for r in whole.groupBy("pair_type").count().collect()}
    monkeypatch.setattr(training, "fit", stop)
    for kind in ("rf", "gbt"):
        with pytest.raises(StopIteration):
            catalog.QUERIES[f"{kind}_score"](spark, sf)
    assert seen == [(sum(kinds.values()), kind, {}) for kind in ("rf", "gbt")]
    some = training.training_set(catalog._norm(spark, sf), catalog._truth(spark, sf), training.LIMITS | {"name_confusion": 7})
    assert {r[0]: r[1] for r in some.groupBy("pair_type").count().collect()} == kinds | {"name_confusion": min(7, kinds["name_confusion"])}


def test_settings():
    assert Settings.from_env({"LINK_BLOCK_CAP": "5", "LINK_PASSES": "exact"}) == Settings(block_cap=5, passes=("exact",))


def test_ratio_sweep_ranks_all_negatives(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    want = sorted(tuple(r) for r in training.ratio_sweep(training.training_set(catalog._norm(spark, sf), catalog._truth(spark, sf))).collect())
    monkeypatch.setattr(training, "LIMITS", dict.fromkeys(training.LIMITS, 5))
    assert sorted(tuple(r) for r in catalog.QUERIES["ratio_sweep"](spark, sf).collect()) == want
    assert sum(r[3] for r in want if r[:2] == (5, 0)) == 5 * sum(r[3] for r in want if r[:2] == (5, 1))


def test_weights_leave_rows_where_they_are(spark):
    df = spark.range(0, 80, 1, 8).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows are many
    try:
        found = training.balanced(df).withColumn("place", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["label"], r["weight"]) for r in found} == {(1, 2.0), (0, 80 / 120)}
    assert len({r["place"] for r in found}) == 8  # not one task for each label


def test_pairs_are_made_once_where_keys_meet(spark):
    """All pairs of all passes were moved to leave one of each; now a pair is left out where it meets again."""
    rows = [(f"S1-{i}", 1, f"acme works {i % 3}", "1 road 12345 54321", "de") for i in range(7)] + [(f"S2-{i}", 2, f"acme works {i % 4}", "9 lane 54321 12345", "DE") for i in range(9)]
    rows += [("S1-90", 1, "", "", ""), ("S2-90", 2, None, "7 way 12345", "de"), ("S3-91", 3, "acme works 1", None, "fr")]
    norm = entities(spark, rows)
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-90"), ("S1-1", "S3-91"), ("S1-90", "S2-2")], "s1_id string, cand_id string")
    for cap in (2, 9, 250):
        got = [tuple(r) for r in blocking.met(norm, truth, cap=cap).select("place", "new", "s1_id", "cand_id", "is_true").collect()]
        want = {(blocking.PASSES.index(r["pass"]), r["s1_id"], r["cand_id"]) for r in blocking.pairs_by_pass(blocking.keys(norm.filter("source = 1")), blocking.keys(norm.filter("source <> 1")), cap).collect()}
        assert len(got) == len(want) and {(p, a, b) for p, _, a, b, _ in got} == want
        new = [(a, b) for _, first, a, b, _ in got if first]
        assert len(new) == len(set(new)) and set(new) == {(a, b) for _, a, b in want}
        true = {tuple(r) for r in truth.collect()}
        assert all(bool(x) == ((a, b) in true) for _, _, a, b, x in got)
        assert {tuple(r) for r in blocking.among(truth, norm, cap=cap).collect()} == true & set(new)


def exchanged(df):
    """Columns that the plan's exchanges move together."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]


def test_scored_pairs_are_not_moved_to_the_truth(spark):
    """Every scored pair was moved to meet the truth, by (s1_id, cand_id)."""
    norm = entities(spark, [("S1-1", 1, "acme", "1 road", "de"), ("S2-1", 2, "acme", "1 road", "de")])
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    judged = scoring.score_logit(scoring.features(scoring.met(norm, truth)))
    assert [tuple(r) for r in judged.select("s1_id", "cand_id", "is_true").collect()] == [("S1-1", "S2-1", 1)]
    assert not [x for x in exchanged(evaluate.labelled(judged, truth)) + exchanged(training.negatives(norm, truth, "name_confusion")) if "s1_id" in x and "cand_id" in x]


@pytest.mark.parametrize("name", ["neg_name", "neg_prefix", "neg_same_addr", "neg_token", "ratio_sample", "training_set", "class_weights"])
def test_negatives_are_mined_from_all_entities(spark, monkeypatch, name):
    """Some 50,000 entities and 300,000 targets at most were drawn by hash before they met, in the SQL too."""
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(training, "SIDES", dict.fromkeys(training.SIDES, (20, 20)))
    monkeypatch.setattr(training, "LIMITS", dict.fromkeys(training.LIMITS, 5))
    assert S.hash48("entity_id") not in catalog.ORACLE_SQL[name]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall())
    assert want and sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf).collect()) == want


def test_a_limit_makes_its_rows_twice(spark):
    """They were made for the histogram, for the lesser buckets and for the last one."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(k):
        made.add(1)
        return k

    df = spark.range(500).select(counted(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("k"))
    assert training.hashed_limit(df.select("k"), 37, "k").count() == 37
    assert made.value < 3 * 500  # some again by a filter that is pushed down
