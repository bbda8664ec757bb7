import json

from cohortline.__main__ import parser, run
from cohortline.operators import metrics, models
from cohortline.plans.trial_adapter import REFERENCE, TRAIN_END, VAL_END, trials


def fake(url, params, timeout):
    return {"studies": [{"protocolSection": {"identificationModule": {"nctId": f"NCT0000000{i}"}}} for i in range(3)]}


def test_stages(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    go = lambda *a: run(spark, parser().parse_args(list(a)))
    trials(spark, "/root/testdata/sf0.001").write.parquet(at("studies.parquet"))
    go("cohort", "--studies", at("studies.parquet"), "--output", at("c"))
    meta = json.loads(next((tmp_path / "c").glob("*_metadata_*.json")).read_text())
    assert meta["n_kept"] + meta["n_excluded"] == spark.read.parquet(at("studies.parquet")).count() and len(meta["content_hash"]) == 12
    go("labels", "--studies", at("studies.parquet"), "--cohort", at("studies.parquet"), "--output", at("l"), "--reference", REFERENCE)
    go("train", "--studies", at("studies.parquet"), "--labels", at("l/labels_*.parquet"), "--output", at("m"), "--benchmark", "broad_full", "--train-end", TRAIN_END, "--val-end", VAL_END, "--today", REFERENCE)
    assert list((tmp_path / "m").rglob("comparison.md")) and list((tmp_path / "m").rglob("eval_logistic_structured_broad_full_*.json"))
    audit = json.loads(next((tmp_path / "l").glob("labels_*_audit.json")).read_text())
    dev = audit["label_types"]["development"]
    assert dev["count"] == audit["cohort_size"] and set(dev["modeling_ready"]) == {"strict", "intermediate", "broad"} and set(dev["soft_negative_flags"]) and dev["event_rule_version"] == ["event_labels_v1"]
    assert dev["excluded_count"] == sum(dev["exclusion_reasons"].values()) and list((tmp_path / "l").glob("labels_wide_*.csv"))
    result = json.loads(next((tmp_path / "m").rglob("eval_logistic_structured_broad_full_test.json")).read_text())
    assert result["calibration_bins"]["mean_predicted_value"] and "tp=" in metrics.summary(result)
    go("features", "--studies", at("studies.parquet"), "--output", at("f"))
    meta = json.loads((tmp_path / "f" / "feature_meta_T0.json").read_text())
    assert meta["tfidf_features"] == spark.read.parquet(at("f/vocabulary_T0.parquet")).count() and meta["structured_features"] > 20
    go("audit", "--studies", at("studies.parquet"), "--labels", at("l/labels_*.parquet"), "--output", at("a"))
    assert next((tmp_path / "a").glob("audit_*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    head = next((tmp_path / "a").glob("audit_*.csv")).read_text(encoding="utf-8-sig").splitlines()[0]
    assert head.startswith('"audit_bucket","nct_id","label_value"') and head.endswith('"url"') and "study_type" not in head


def test_ingest_and_flatten(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    run(spark, parser().parse_args(["ingest", "--output", str(tmp_path), "--client", "test_cli:fake", "--delay", "0"]))
    raw = next(tmp_path.glob("raw_*.jsonl"))
    assert json.loads(next(tmp_path.glob("*.metadata.json")).read_text())["study_count"] == 3
    assert spark.read.text(str(raw)).count() == 3
    run(spark, parser().parse_args(["flatten", "--raw", str(raw), "--output", str(tmp_path / "flat")]))
    assert sorted(r["nct_id"] for r in spark.read.parquet(str(tmp_path / "flat.parquet")).collect()) == ["NCT00000000", "NCT00000001", "NCT00000002"]


def test_grid_goes_on_after_a_failure(spark):
    split = spark.createDataFrame([(f"N{i}", ["train", "val", "test"][i % 3], int(i % 4 == 0)) for i in range(60)], "nct_id string, split string, y int")
    snap = spark.createDataFrame([(f"N{i}", i % 4) for i in range(60)], "nct_id string, n_arms int")
    grid = [{"model": "logistic", "features": "structured", "benchmark": "strict"}, {"model": "logistic", "features": "none", "benchmark": "strict"}]
    results, failures = models.run_grid({"strict": split}, snap, grid)
    assert len(results) == 2 and len(failures) == 1 and "unknown feature set" in failures[0]["error"]
