import contextlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import audit, cohort, features, labels, linkage, metrics, models, snapshots, splits, text
from cohortline.sources import registry_json, rest, storage

TRIAL = dict(nct_id="NCT00000001", ordinal=1, brief_title="A study", overall_status="COMPLETED", why_stopped=None, study_type="Interventional", phases="PHASE2", lead_sponsor="Acme",
             lead_sponsor_class="INDUSTRY", intervention_types="Drug", intervention_names="DrugX", conditions="Asthma", enrollment="100", has_results=False, primary_purpose="TREATMENT",
             start_date="2019-01-01", first_post_date="2019-06-01", primary_completion_date="2021-06-01", completion_date="2021-12-01", last_update_post_date=None, status_verified_date=None)
SCHEMA = "nct_id string, ordinal long, brief_title string, overall_status string, why_stopped string, study_type string, phases string, lead_sponsor string, lead_sponsor_class string, intervention_types string, intervention_names string, conditions string, enrollment string, has_results boolean, primary_purpose string, start_date string, first_post_date string, primary_completion_date string, completion_date string, last_update_post_date string, status_verified_date string"


def trials(spark, *changes):
    rows = [TRIAL | {"nct_id": f"NCT{i:08d}", "ordinal": i} | c for i, c in enumerate(changes, 1)]
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in SCHEMA.split(", ")) for r in rows], SCHEMA)


def reasons(spark, config, *changes):
    return [r["exclusion_reason"] for r in cohort.with_reason(trials(spark, *changes), config).orderBy("ordinal").collect()]


def test_cascade(spark):
    C = cohort.CohortConfig
    assert reasons(spark, C(study_type=["Interventional"]), {}, {"study_type": "Observational"}, {"study_type": None}) == [None, "study_type not in ['Interventional']"] + ["study_type not in ['Interventional']"]
    assert reasons(spark, C(intervention_type=["Drug", "Biological"]), {"intervention_types": "Drug; Device"}, {"intervention_types": None})[0] is None
    assert reasons(spark, C(phase=["Phase 1"]), {"phases": "Phase 1/Phase 2"}, {"phases": "PHASE1"}, {"phases": "Phase 3"})[:2] == [None, None]
    assert reasons(spark, C(excluded_study_type=["Observational"]), {"study_type": None}) == [None]
    assert reasons(spark, C(excluded_intervention_type=["Device"]), {"intervention_types": "Drug; Device"}, {"intervention_types": "Device"}, {"intervention_types": None})[0] is None
    assert reasons(spark, C(required_fields=["start_date", "no_such_field"]), {"start_date": None})[0].startswith("missing required")
    kept, out = cohort.apply_filters(trials(spark, {}, {"study_type": "Observational"}, {"lead_sponsor_class": "OTHER"}, {"phases": "Phase 4"}), cohort.STANDARD)
    assert kept.count() == 1 and out.count() == 3
    assert cohort.apply_filters(trials(spark, {}).limit(0), cohort.STANDARD)[0].count() == 0


def test_summary(spark):
    s = cohort.summarize(trials(spark, {"enrollment": "100"}, {"enrollment": "500"}))
    assert s["enrollment"]["least"] == 100 and s["enrollment"]["most"] == 500 and s["enrollment"]["n"] == 2


def find(spark, change, anchor=None):
    t = trials(spark, anchor or {}, {"phases": "PHASE3", "start_date": "2022-03-01", "first_post_date": "2021-09-01"} | change)
    return linkage.successor_pairs(t.where("ordinal = 1"), t).collect()


def test_successors(spark):
    got = find(spark, {})
    assert len(got) == 1 and got[0]["temporal_gap_months"] == 9.0 and got[0]["condition_overlap"] == 1.0
    assert len(find(spark, {"intervention_names": "DrugXX"})) == 1  # alike, not equal
    for bad in ({"lead_sponsor": "Other"}, {"intervention_names": "Something"}, {"start_date": "2026-01-01"}, {"phases": "PHASE2"}, {"first_post_date": "2018-01-01"}, {"conditions": "Gout"}, {"start_date": None}):
        assert find(spark, bad) == []
    assert len(find(spark, {"first_post_date": None})) == 1
    assert find(spark, {}, {"lead_sponsor": None}) == []


def test_first_successors_are_counted_where_they_meet(spark):
    """As from all pairs: of studies at one place, the smallest id that is a successor."""
    late = {"phases": "PHASE3", "start_date": "2022-03-01", "first_post_date": "2021-09-01", "ordinal": 7}
    t = trials(spark, {"intervention_names": "DrugX; DrugY"}, late | {"conditions": "Gout"}, late | {"intervention_names": "drugy; drugx"}, late, late | {"ordinal": 9}, {"nct_id": "B", "intervention_names": "; ;", "lead_sponsor": "b"}, late | {"intervention_names": "; ;", "lead_sponsor": "b"})
    a = t.where("phases = 'PHASE2'")
    got = {r["nct_id"]: (r["n_successors"], r["successor_id"], r["condition_overlap"]) for r in linkage.first_of(a, t, fuzzy=False).collect()}
    assert got == {"NCT00000001": (3, "NCT00000003", 1.0), "B": (1, "NCT00000007", 1.0)}
    assert got == {r["nct_id"]: (r["n_successors"], r["successor_id"], r["condition_overlap"]) for r in linkage.first_successor(linkage.successor_pairs(a, t, fuzzy=False)).collect()}


def label(spark, *changes, studies=None):
    t = trials(spark, *changes)
    return [r["label_value"] for r in labels.development(t, t).join(t.select("nct_id", "ordinal"), "nct_id").orderBy("ordinal").collect()]


def test_decision_list(spark):
    got = label(spark, {"lead_sponsor": "a", "overall_status": "TERMINATED", "why_stopped": "Lack of efficacy"}, {"lead_sponsor": "b", "overall_status": "TERMINATED"},
                {"lead_sponsor": "c", "why_stopped": "Primary endpoint met"}, {"lead_sponsor": "d"}, {"lead_sponsor": "e", "overall_status": "RECRUITING"}, {"lead_sponsor": "f", "phases": "PHASE1; PHASE2"},
                {"lead_sponsor": "g", "primary_purpose": "PREVENTION"}, {"lead_sponsor": "h", "overall_status": "TERMINATED", "why_stopped": "futile"},
                {"lead_sponsor": "h", "phases": "PHASE3", "start_date": "2022-01-01"}, {"lead_sponsor": "i", "overall_status": "SUSPENDED"})
    assert got == ["hard_negative", "ambiguous_negative", "excluded_positive_terminal", "soft_negative", "censored_in_progress", "excluded_mixed_phase", "excluded_non_treatment_purpose", "advanced", "excluded_wrong_phase", "soft_negative"]


def test_factory(spark):
    t = trials(spark, {}, {"overall_status": "TERMINATED", "why_stopped": "futility", "lead_sponsor": "z"})
    out = labels.build(t, t, F.lit("2022-01-01").cast("date"))
    assert out.columns[:8] == labels.LEGACY_COLUMNS and out.columns[8:15] == labels.EVENT_COLUMNS
    dev = {r["nct_id"]: r for r in out.where("label_type = 'development'").collect()}
    assert dev["NCT00000001"]["label_value"] == "censored_recent" and dev["NCT00000001"]["event_observed"] is None
    assert dev["NCT00000002"]["label_value"] == "censored_early_negative" and dev["NCT00000002"]["event_category"] == "censored_negative_signal"
    assert out.where("label_type = 'operational' and event_label is not null").count() == 0
    again = labels.with_events(labels.with_task(out))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_snapshots(spark):
    t = trials(spark, {})
    counts = [len(snapshots.available(p)) for p in snapshots.TIMEPOINTS]
    assert counts == [47, 49, 50, 59, 60, 60, 60]
    assert "overall_status" not in snapshots.snapshot(t, "T2").columns and "start_date" in snapshots.snapshot(t, "T1").columns
    assert snapshots.leaking(["why_stopped", "phases", "unknown"], "T0") == ["why_stopped"] and snapshots.forecasting_safe("enrollment")
    with pytest.raises(ValueError):
        snapshots.available("T9")
    with pytest.raises(ValueError):
        snapshots.validate(t, "T0")
    assert snapshots.compare(snapshots.snapshot(t, "T0"), snapshots.snapshot(t, "T1"))["added"] == ["start_date"]


def test_benchmarks_and_splits(spark):
    rows = [(f"N{i}", "development", "phase2_to_phase3_v1", v, f, b) for i, (v, f, b) in enumerate(
        [("advanced", None, None)] * 20 + [("hard_negative", None, None)] * 30 + [("ambiguous_negative", None, None)] * 15 + [("soft_negative", i < 10, i < 5) for i in range(40)] + [("censored_recent", None, None)] * 10)]
    lab = spark.createDataFrame(rows, "nct_id string, label_type string, label_task string, label_value string, common_asset_flag boolean, broad_basket_flag boolean")
    studies = spark.createDataFrame([(r[0], "20%02d-01-01" % (10 + i % 10)) for i, r in enumerate(rows[:-1])] + [(rows[-1][0], None)], "nct_id string, first_post_date string")
    n = {b.name: splits.dataset(lab, studies, b.name, today=F.lit("2030-01-01").cast("date")).where("y = 0").count() for b in splits.LADDER}
    assert n == {"strict": 30, "intermediate": 45, "broad_filtered": 75, "broad_full": 85}
    with pytest.raises(ValueError):
        splits.benchmark("none")
    s = splits.temporal_split(splits.dataset(lab, studies, "strict", today=F.lit("2030-01-01").cast("date")), studies, "2014-12-31", "2016-12-31")
    assert {r["split"]: r["n_total"] for r in splits.split_stats(s).collect()} == {"train": 25, "val": 10, "test": 15}
    assert splits.dataset(lab, studies, "strict", today=F.lit("2015-06-01").cast("date")).count() < 50


def test_metrics(spark):
    df = spark.createDataFrame([(str(i), s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.5, 0)])], "nct_id string, score double, y int")
    assert abs(metrics.average_precision(df).first()[0] - (1 + 2 / 3 + 3 / 4) / 3) < 1e-9
    assert abs(metrics.auroc(df).first()[0] - 4 / 6) < 1e-9
    assert metrics.f1_threshold(df).first()["threshold"] == 0.6
    e = metrics.evaluate(df)
    assert e["confusion"] == {"tn": 1, "fp": 1, "fn": 0, "tp": 3} and e["threshold_source"] == "self"
    assert metrics.evaluate(df, threshold=0.95)["confusion"]["tp"] == 0
    one = df.withColumn("y", F.lit(0))
    assert metrics.average_precision(one).first()[0] == 0.0 and metrics.auroc(one).first()[0] == 0.5 and metrics.f1_threshold(one).first()["threshold"] == 0.5
    assert metrics.comparison([]) == "No results to compare."


def test_tfidf_uses_training_vocabulary(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta", True), ("b", "alpha gamma", True), ("c", "delta alpha", False), ("d", "beta gamma", True)], "id string, t string, train boolean")
    w, vocab = text.tfidf(docs, "id", "t", text.TfidfConfig(min_df=1, ngrams=(1, 2)), train=F.col("train"))
    terms = {r["term"] for r in vocab.collect()}
    assert "delta" not in terms and "alpha beta" in terms and "beta beta" in terms
    norms = {r["id"]: r["n"] for r in w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert all(abs(n - 1) < 1e-9 for n in norms.values())
    zero = docs.unionByName(spark.createDataFrame([("e", "", True), ("f", None, False)], docs.schema))
    got = {r["id"]: r["features"] for r in text.vectors(zero, vocab, "id", "t", text.TfidfConfig(min_df=1)).collect()}
    assert len(got) == 6 and got["e"].numNonzeros() == got["f"].numNonzeros() == 0
    by_term = sorted(terms)
    assert all(abs(got[r["id"]][by_term.index(r["term"])] - r["weight"]) < 1e-12 for r in w.collect())


def test_structured_and_models(spark):
    rows = [(f"N{i}", "train" if i < 30 else "val" if i < 40 else "test", int(i % 3 == 0), "A" if i % 3 == 0 else "B", i % 7, ["x alpha text", "y beta text"][int(i % 3 == 0)]) for i in range(50)]
    df = spark.createDataFrame(rows, "nct_id string, split string, y int, sex string, n_arms int, brief_title string")
    snap = df.drop("split", "y")
    with pytest.warns(UserWarning):
        p = models.prepare(df.select("nct_id", "split", "y"), snap, "fusion", text.TfidfConfig(min_df=1))
    p = p.cache()
    model, meta = models.train_logistic(p.where("split = 'train'"))
    got = models.evaluate_model(model, p)
    assert got["val"]["auroc"] == 1.0 and got["test"]["threshold_source"] == "validation" and got["test"]["threshold_value"] == got["val"]["threshold_value"]
    with pytest.raises(ValueError):
        models.prepare(df, snap, "other")
    scored = models.predict(model, p).select("nct_id", "score", "y")
    assert models.calibrated(models.platt(scored), scored).where("calibrated between 0 and 1").count() == 50


@pytest.mark.parametrize("kind", ["structured", "text", "fusion"])
def test_preparation_keeps_every_study(spark, kind):
    rows = [(f"N{i}", ["train", "val", "test"][i % 3], i % 2, "A" if i % 2 else None, i % 7, None if i == 4 else "" if i == 5 else "zz qq" if i == 8 else "alpha beta") for i in range(12)]
    df = spark.createDataFrame(rows, "nct_id string, split string, y int, sex string, n_arms int, brief_title string")
    with pytest.warns(UserWarning) if kind != "text" else contextlib.nullcontext():
        got = models.prepare(df.select("nct_id", "split", "y"), df.drop("split", "y"), kind, text.TfidfConfig(min_df=1)).collect()
    assert sorted(r["nct_id"] for r in got) == sorted(r[0] for r in rows) and all(r["features"].size == got[0]["features"].size for r in got)


def test_model_files(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "x double, y int")
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model, meta = models.train_logistic(data)
    models.save(model, meta, str(tmp_path / "m"))
    again, info = models.load(spark, str(tmp_path / "m"))
    assert info["model"] == "logistic" and models.predict(again, data).count() == 10


def test_audit_sample(spark):
    lab = spark.createDataFrame([(f"N{i}", v) for i, v in enumerate(["advanced"] * 60 + ["hard_negative"] * 3 + ["excluded_wrong_phase"] * 9)], "nct_id string, label_value string")
    got = {r["audit_bucket"]: r["count"] for r in audit.sample(lab).groupBy("audit_bucket").count().collect()}
    assert got == {"positive (advanced)": 50, "negative (hard)": 3, "edge (excluded)": 5}


RECORD = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "T"}, "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 7}},
          "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "b"}, {"type": "BIOLOGICAL", "name": None}, {"name": "c"}]},
          "contactsLocationsModule": {"locations": [{"country": "Spain"}, {"country": "France"}, {"country": "Spain"}, {}]}}, "hasResults": True}


def test_flatten(spark, tmp_path):
    second = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "later"}}}
    (tmp_path / "raw.json").write_text(json.dumps({"metadata": {}, "studies": [RECORD, second, {"protocolSection": {"identificationModule": {"nctId": "NCT00000002"}}}]}))
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "raw.json").write_text(json.dumps([RECORD]))
    flat = {r["nct_id"]: r for r in registry_json.flatten(registry_json.read_raw(spark, str(tmp_path / "raw.json"))).collect()}
    assert len(flat) == 2 and flat["NCT00000001"]["brief_title"] == "later" and flat["NCT00000002"]["n_arms"] == 0 and flat["NCT00000002"]["has_results"] is False
    one = registry_json.flatten(registry_json.read_raw(spark, str(tmp_path / "bare"))).first()
    assert one["phases"] == "PHASE1; PHASE2" and one["intervention_names"] == "b; None; c" and one["intervention_types"] == "; BIOLOGICAL; DRUG" and one["countries"] == "France; Spain" and one["enrollment"] == 7
    assert set(one.asDict()) - {"ordinal"} == set(snapshots.REGISTRY)


def fake(url, params, timeout):
    page = int(params.get("pageToken", 0))
    return {"studies": [{"id": page * 2 + i} for i in range(2)], **({"nextPageToken": str(page + 1)} if page < 2 else {})}


def test_rest():
    assert len(list(rest.pull(fake, {}, sleep=lambda s: None))) == 6 and len(list(rest.pull(fake, {}, most=3, sleep=lambda s: None))) == 3
    p = rest.parameters(["COMPLETED", "TERMINATED"], ["PHASE2", "PHASE3"], {"cond": "asthma"}, "AREA[X]Y", 5000)
    assert p["filter.overallStatus"] == "COMPLETED|TERMINATED" and p["pageSize"] == "1000" and p["query.cond"] == "asthma"
    assert p["filter.advanced"] == "(AREA[Phase]PHASE2 OR AREA[Phase]PHASE3) AND (AREA[X]Y)"
    with pytest.raises(ValueError):
        rest.parameters(["NOPE"])


REGISTRY_ROWS = [{"id": i, "status": rest.STATUSES[i % 3], "phases": [["PHASE1"], ["PHASE1", "PHASE2"], ["PHASE2"], ["PHASE3"], ["PHASE2", "PHASE3"], []][i % 6]} for i in range(90)]
ASKED = []


def holds(row, params) -> bool:
    """What the server makes of the filters that this engine sends."""
    wanted = params.get("filter.overallStatus")
    expr = re.sub(r"AREA\[Phase\](\w+)", lambda m: str(m[1] in row["phases"]), params.get("filter.advanced", "True"))
    return (not wanted or row["status"] in wanted.split("|")) and eval(expr.replace("NOT", "not").replace("OR", "or").replace("AND", "and"))  # noqa: S307


def served(url, params, timeout):
    found, at, size = [r for r in REGISTRY_ROWS if holds(r, params)], int(params.get("pageToken", 0)), int(params["pageSize"])
    ASKED.append(params)
    return {"studies": found[at:at + size], **({"nextPageToken": str(at + size)} if at + size < len(found) else {})}


def unsteady(url, params, timeout):
    """Fails on every fifth request."""
    if len(ASKED) % 5 == 4:
        ASKED.append(None)
        raise TimeoutError
    return served(url, params, timeout)


@pytest.mark.parametrize("slices,n", [("", 1), ("status", 3), ("phase", 3), ("status,phase", 9)])
def test_rest_slices_are_disjoint_and_whole(slices, n):
    o = {"statuses": ",".join(rest.STATUSES[:3]), "phases": "PHASE3,PHASE1,PHASE2,PHASE1" if n == 3 else "PHASE1,PHASE2,PHASE3", "slices": slices, "pagesize": "7", "delay": "0", "client": f"{__name__}:served"}
    reader = rest._Reader(o)
    got = [json.loads(r[0])["id"] for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == n and sorted(got) == [r["id"] for r in REGISTRY_ROWS if r["phases"]]
    for bad in ({"slices": "sex"}, {"slices": "phase", "phases": ""}, {"slices": "status", "maxstudies": "3"}):
        with pytest.raises(ValueError):
            rest._Reader(o | bad).partitions()
    assert rest.chains([], ["PHASE1", "PHASE2"], "A OR B", ["phase"]) == [([], ["PHASE1"], "A OR B"), ([], ["PHASE2"], "(A OR B) AND NOT (AREA[Phase]PHASE1)")]


@pytest.mark.parametrize("uri", [False, True])
def test_rest_goes_on_after_a_failure(tmp_path, uri):
    """A failed chain, run again, asks only for what is not kept; no row is lost or doubled, and a whole chain asks for nothing."""
    folder = f"file://{tmp_path}" if uri else str(tmp_path)
    reader = rest._Reader({"statuses": ",".join(rest.STATUSES[:3]), "slices": "status", "pagesize": "4", "delay": "0", "pages": folder, "client": f"{__name__}:unsteady"})
    ASKED.clear()
    got, failures = [], 0
    for p in reader.partitions():
        while True:
            try:
                rows = [json.loads(r[0])["id"] for r in reader.read(p)]  # what a failed attempt gave is dropped, as Spark does
                break
            except TimeoutError:
                failures += 1
        got += rows
    answered = [json.dumps(a, sort_keys=True) for a in ASKED if a]
    assert failures >= 4 and sorted(got) == list(range(90)) and len(answered) == len(set(answered)) == 24
    assert sorted(json.loads(r[0])["id"] for p in reader.partitions() for r in reader.read(p)) == list(range(90)) and len([a for a in ASKED if a]) == 24
    assert len(list(rest.pull(served, {"pageSize": "4"}, most=6, sleep=lambda s: None, folder=folder))) == 6
    assert len(list(rest.pull(served, {"pageSize": "4"}, most=9, sleep=lambda s: None, folder=folder))) == 9  # goes on behind the six
    assert not list(tmp_path.rglob("*.part"))


def test_rest_by_spark(spark, tmp_path):
    """Tasks of Spark, one a chain, on a client that workers import."""
    (tmp_path / "steady_client.py").write_text("def get(url, params, timeout):\n    at = int(params.get('pageToken', 0))\n    return {'studies': [{'id': params['filter.overallStatus'] + str(at)}], **({'nextPageToken': str(at + 1)} if at < 4 else {})}\n")
    spark.sparkContext.addPyFile(str(tmp_path / "steady_client.py"))
    spark.dataSource.register(rest.RegistryApi)
    df = spark.read.format("registry_api").option("statuses", "COMPLETED,TERMINATED").option("slices", "status").option("delay", "0").option("pages", str(tmp_path / "kept")).option("client", "steady_client:get").load()
    for _ in range(2):
        assert df.rdd.getNumPartitions() == 2 and sorted(json.loads(r[0])["id"] for r in df.collect()) == sorted(s + str(i) for s in ("COMPLETED", "TERMINATED") for i in range(5))
    assert len(list((tmp_path / "kept").rglob("*.json"))) == 10


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c')], "i int, s string")
    p = storage.save(df, str(tmp_path / "x.csv"), "parquet")
    assert p.endswith("x.parquet") and storage.load(spark, p).first()["s"] == 'a "b", c'
    assert storage.load(spark, storage.save(df, str(tmp_path / "y"), "csv")).first()["s"] == 'a "b", c'
    assert storage.latest(spark, str(tmp_path / "*.parquet")).endswith("x.parquet")
    for bad, error in (("z.parquet", FileNotFoundError), ("z.txt", ValueError)):
        with pytest.raises(error):
            storage.load(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        storage.save(df, "x", "orc")
    storage.save_review(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf\"i\"")


def test_snapshot_parts(spark, tmp_path):
    t = trials(spark, {}, {"overall_status": "TERMINATED"})
    assert snapshots.snapshot_row(t, "NCT00000002", "T3")["overall_status"] == "TERMINATED" and "overall_status" not in snapshots.snapshot_row(t, "NCT00000002", "T0")
    assert snapshots.snapshot_row(t, "NCT99999999", "T0") is None
    every = snapshots.all_snapshots(t, ["T0", "T3"])
    assert list(every) == ["T0", "T3"] and list(snapshots.all_snapshots(t)) == snapshots.TIMEPOINTS
    meta = snapshots.metadata(every["T0"], "T0")
    assert meta["n_rows"] == 2 and meta["leakage_clean"] and not snapshots.metadata(t, "T0")["leakage_clean"]
    paths = storage.save_snapshots(every, meta, str(tmp_path))
    assert storage.load(spark, paths[0]).columns == every["T0"].columns and json.loads(open(paths[-1]).read())["timepoint"] == "T0"


def test_registry_of_features(tmp_path):
    (tmp_path / "f.yaml").write_text("categorical:\n- {name: sex, source_column: sex}\nnumeric:\n- {name: enrollment, source_column: enrollment, time_availability: T2, impute: median, log_transform: true}\nderived:\n- {name: n_c, source_column: conditions, derivation: count_delimited}\n")
    texts = {"text_fields": [{"name": "title", "source_column": "brief_title"}], "tfidf": {"max_features": 10, "ngram_range": [1, 1]}}
    r = features.Registry.from_configs(storage.load_config(str(tmp_path / "f.yaml")), texts)
    assert r.names() == ["sex", "enrollment", "n_c", "text_title", "tfidf"] and len(r) == 5 and r.get("enrollment").extra == {"impute": "median", "log": True}
    assert [f.name for f in r.leaking("T0")] == ["enrollment"] and [f.name for f in r.safe("T1")] == ["sex", "n_c", "text_title", "tfidf"] and r.leaking("T2") == []
    assert [f.name for f in r.by_type("numeric")] == ["enrollment"] and r.get("none") is None and text.TfidfConfig.from_config(texts["tfidf"]) == text.TfidfConfig(10, (1, 1))


def test_date_column_falls_back(spark):
    df = spark.createDataFrame([(i, "soon", None, f"20{10 + i}-05") for i in range(5)], "ordinal long, first_post_date string, start_date string, last_update_post_date string").withColumn("nct_id", F.col("ordinal").cast("string"))
    assert splits.date_column(df) == "last_update_post_date"
    with pytest.raises(ValueError):
        splits.date_column(df.drop("last_update_post_date"))
    data = df.select("nct_id", F.lit(1).alias("y"))
    got = {r["nct_id"]: r["split"] for r in splits.temporal_split(data, df, "2011-12-31", "2012-12-31", "last_update_post_date").collect()}
    assert got == {"0": "train", "1": "train", "2": "val", "3": "test", "4": "test"}
    with pytest.warns(UserWarning):
        s = splits.summary(splits.temporal_split(data, df, "2030-01-01", "2031-01-01", "last_update_post_date"), "last_update_post_date", "2030-01-01", "2031-01-01")
    assert s["train"]["n_total"] == 5 and len(s["warnings"]) == 2 and s["yearly_counts"]["train"][2010]["n_total"] == 1


def test_distributions(spark):
    df = spark.createDataFrame([(str(i), float(i), 7, "ab"[i % 2], i % 3 or None) for i in range(150)], "nct_id string, `a.b` double, c int, d string, e int")
    with pytest.warns(UserWarning, match="constant"):
        got = features.distributions(df)
    assert got["constant_columns"] == ["c"] and got["high_cardinality"] == ["a.b"] and got["stats"]["d"] == {"unique": 2, "top_values": {"a": 75, "b": 75}} and got["stats"]["a.b"]["max"] == 149
    assert features.missing_report(df, 0.3)["flagged"] == [("e", 1 / 3)]
    with pytest.raises(ValueError, match="categories"):
        features.categories(df, ["nct_id"], most=100)


def newton(x, y, weight, reg):
    """Ridge logistic regression with an intercept that is not penalised, to the optimum."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pen = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, reg), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (weight * (y - p)) - pen * w)
    return 1 / (1 + np.exp(-x @ w))


def test_logistic_and_platt_reach_the_optimum(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3))
    y = (x @ [1.5, -1, 0.2] + rng.logistic(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(str(i), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "nct_id string, a double, b double, c double, y int")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model, meta = models.train_logistic(data, {"params": {"C": 0.5}})
    assert meta["params"] == {"C": 0.5, "max_iter": 1000} and meta["n_features"] == 3
    weight = np.where(y > 0, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    got = {r["nct_id"]: r["score"] for r in models.predict(model, data).collect()}
    assert np.abs(np.array([got[str(i)] for i in range(300)]) - newton(x, y, weight, 1 / 0.5)).max() < 1e-3
    scores = models.predict(model, data).select("nct_id", "score", "y")
    cal = {r["nct_id"]: r["calibrated"] for r in models.calibrated(models.platt(scores), scores).collect()}
    s = np.array([got[str(i)] for i in range(300)])
    assert np.abs(np.array([cal[str(i)] for i in range(300)]) - newton(s[:, None], y, np.ones(300), 0)).max() < 1e-3
    assert models.depth_of(models.BOOSTING) == 5 and models.train_gbt(data, n_estimators=3)[1]["params"]["num_leaves"] == 31


def test_streams(spark, tmp_path):
    from cohortline.streaming import rows

    t = trials(spark, {}, {"study_type": "Observational"}, {"overall_status": "TERMINATED"})
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    for name, made, want in (("marks", rows.mark_exclusions(stream), cohort.with_reason(t, cohort.STANDARD)), ("labels", rows.operational_labels(stream), labels.operational(t))):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, want.collect()))


def point(url, params, timeout):
    return {"at": url, "format": params["format"]}


def test_one_study_by_its_id():
    reader = rest._Reader({"nctid": "NCT00000001", "client": f"{__name__}:point"})
    (row,) = reader.read(reader.partitions()[0])
    assert json.loads(row[0])["at"].endswith("/NCT00000001") and json.loads(row[0])["format"] == "json"


def test_stages_follow_their_inputs(spark, tmp_path):
    """A rewritten input gives new rows, an unchanged one the same table; another plan or name is another table; tables can be removed."""
    from cohortline.sources import storage

    path, built = f"{tmp_path}/a b.parquet", []

    def stage(name="s", least=0):
        def build():
            built.append(name)
            return spark.read.parquet(path).where(F.col("id") >= least)

        return storage.staged(spark, ("test", name), build)

    spark.range(3).write.parquet(path)
    old = stage()
    assert old.count() == 3 and stage().inputFiles() == old.inputFiles()
    spark.range(9).write.mode("overwrite").parquet(path)
    assert stage().count() == 9 and old.count() == 3  # a frame goes on reading its own table
    assert stage(least=4).count() == 5 and stage(name="t").count() == 9
    extra = spark.range(100, 102)
    extra.write.mode("append").parquet(path)
    assert stage().count() == 11
    built.clear()  # with its inputs named, a table that is there is not described again
    named = lambda: storage.staged(spark, ("test", "named"), lambda: built.append(1) or spark.read.parquet(path), spark.read.parquet(path)).count()
    assert named() == named() == 11 and built == [1]
    extra.write.mode("append").parquet(path)
    assert named() == 13 and built == [1, 1]
    assert storage.unstage(spark, "test", "s") == 4 and storage.unstage(spark, "test") == 3 and stage().count() == 13
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        storage.staged(spark, ("test", "broken"), lambda: spark.range(1).select(F.expr("1 / id").alias("x")))
    assert storage.unstage(spark, "test", "broken") == 0


def test_stages_go_with_the_application(tmp_path):
    import subprocess
    import sys
    import time

    program = f"""
from pyspark.sql import SparkSession
from cohortline.sources import storage
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
import os
print(storage.staged(s, ("x",), lambda: s.range(5)).count(), len(os.listdir("{tmp_path}/cohortline-stages")))
"""
    for end in ("", "s.stop()"):
        done = subprocess.run([sys.executable, "-c", program + end], capture_output=True, text=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
        assert done.stdout.split() == ["5", "1"], done.stderr[-2000:]
        until = time.time() + 30
        while list(tmp_path.glob("cohortline-stages/*")) and time.time() < until:
            time.sleep(0.2)  # the JVM ends a moment after Python
        assert not list(tmp_path.glob("cohortline-stages/*"))


def _scores(spark, n, distinct, seed=0):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, distinct, n) / distinct
    y = (rng.random(n) < 0.2 + 0.6 * s).astype(int)
    return spark.createDataFrame([(f"k{i}", float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "nct_id string, score double, y int"), s, y


def test_curves_in_any_number_of_ranges(spark):
    """Ranges follow the rows and don't change a result; none holds more than its share of rows where scores differ."""
    df, s, y = _scores(spark, 3000, 900)
    v = np.sort(np.unique(s))[::-1]
    want = [(float(x), int(y[s >= x].sum()), int((1 - y)[s >= x].sum())) for x in v]
    for how in ({"ranges": 1}, {"ranges": 2}, {}, {"rows": 20}, {"ranges": 700}):
        got = sorted(((r["s"], r["tp"], r["fp"]) for r in metrics.curve(df, **how).collect()), reverse=True)
        assert got == want, how
    assert metrics.curve(df.limit(0)).count() == 0
    one = spark.createDataFrame([("a", 0.5, 1)] * 50 + [("b", 0.5, 0)] * 10, "nct_id string, score double, y int")
    assert [tuple(r) for r in metrics.curve(one).collect()] == [(0.5, 50, 10, 50, 10, 50, 10)]
    cuts = metrics.cuts_of(df, rows=20)
    sizes = [r["n"] for r in metrics.located(metrics.by_score(df), cuts).groupBy("part", "sub").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()]
    assert len(cuts) > 120 and max(sizes) <= 60


def test_bootstrap_over_ranges(spark):
    """Draws in two steps have the spread of draws in one, and of whole rows drawn; every replicate draws as many rows as there are."""
    df, s, y = _scores(spark, 1500, 100_000, 3)
    got = {k: {r["metric"]: (r["low"], r["high"]) for r in metrics.bootstrap(df, 400, ranges=k).collect()} for k in (1, 40)}
    rng, est = np.random.default_rng(1), {m: [] for m in metrics.INTERVALS}
    for _ in range(400):
        i = np.concatenate([rng.choice(np.flatnonzero(y == c), (y == c).sum()) for c in (1, 0)])
        v, n = np.unique(-s[i], return_inverse=True)
        p, q = np.bincount(n, y[i]), np.bincount(n, 1 - y[i])
        for m, f in metrics.INTERVALS.items():
            est[m].append(f(p, q, 0, 0, p.sum(), q.sum()))
    for m, e in est.items():
        low, high = np.percentile(e, [2.5, 97.5])
        for k in got:
            assert abs(got[k][m][0] - low) <= 0.25 * (high - low) and abs(got[k][m][1] - high) <= 0.25 * (high - low), (m, k)
    # a metric is a sum over ranges
    v, n = np.unique(-s, return_inverse=True)
    p, q = np.bincount(n, y), np.bincount(n, 1 - y)
    for f in metrics.INTERVALS.values():
        parts = [f(p[i:i + 211], q[i:i + 211], p[:i].sum(), q[:i].sum(), p.sum(), q.sum()) for i in range(0, len(p), 211)]
        assert abs(sum(parts) - f(p, q, 0, 0, p.sum(), q.sum())) < 1e-9
    assert metrics.bootstrap(df, 3, ranges=40).collect() == metrics.bootstrap(df, 3, ranges=40).collect()
    assert all(r["low"] is None for r in metrics.bootstrap(df.where("y = 1")).collect())


def test_exact_medians(spark):
    from cohortline.operators import selection

    rng = np.random.default_rng(2)
    for values in (rng.normal(size=4001), rng.exponential(size=4000) ** 5, np.concatenate([np.zeros(3000), rng.normal(size=2500)]), np.concatenate([np.full(2000, 7.0), rng.normal(size=2000) + 7]), np.array([1.0, 2, 3, 10])):
        df = spark.createDataFrame([(float(v), None if i % 5 == 0 else float(v), 1) for i, v in enumerate(values)], "a double, b double, c int")
        got = selection.medians(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "none": F.lit(None)}, most=40)
        assert got == {"a": float(np.median(values)), "b": float(np.median(np.delete(values, np.arange(0, len(values), 5)))), "c": 1.0, "none": None}
    assert selection.medians(df.limit(0), {"a": F.col("a")}) == {"a": None}


def test_a_million_categories(spark):
    """A column of a million values and one of three as a table of places and sparse vectors, in the order that columns would have."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").cast("string").alias("nct_id"), F.concat(F.lit("site "), F.pmod(F.col("id") * 7919, F.lit(n))).alias("site"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("sex"))
    with pytest.raises(ValueError, match="category_index"):
        features.categories(df, ["site", "sex"])
    index = features.category_index(df, ["site", "sex"])
    assert index.count() == n + 3 and index.agg(F.max("i"), F.count_distinct("i")).first()[:] == (n + 2, n + 3)
    low = {(r["feature"], r["value"]): r["i"] for r in index.where("i < 4 or i > 1000001").collect()}
    sites = sorted(f"site {i}" for i in range(n))
    assert low == {("sex", "False"): 0, ("sex", "MISSING"): 1, ("sex", "True"): 2, ("site", sites[0]): 3, ("site", sites[-1]): n + 2}
    some = df.where("id % 100000 = 17").unionByName(spark.createDataFrame([("new", "nowhere", None)], df.schema))
    got = {r["nct_id"]: r["at"] for r in features.sparse_one_hot(some, ["site", "sex"], index).collect()}
    place = {s: i + 3 for i, s in enumerate(sites)}
    assert got.pop("new") == [1] and got == {str(i): [{0: 1, 1: 2, 2: 0}[i % 3], place[f"site {i * 7919 % n}"]] for i in range(17, n, 100_000)}
    small = features.category_index(some, ["sex"])
    assert sorted(r["at"][0] for r in features.sparse_one_hot(some, ["sex"], small).collect()) == sorted(small.where("feature = 'sex'").join(features._by_value(some, ["sex"], "nct_id"), ["feature", "value"]).toPandas()["i"])
    vectors = text.sparse_vectors(spark.createDataFrame([("a", [1, 4], [0.5, 2.0]), ("b", [], [])], "k string, at array<int>, w array<double>"), 6, "k", "at", "w")
    from pyspark.ml.linalg import Vectors

    assert {r["k"]: r["features"] for r in vectors.collect()} == {"a": Vectors.sparse(6, [1, 4], [0.5, 2.0]), "b": Vectors.sparse(6, [], [])}


def test_text_columns_are_profiled_in_one_pass(spark):
    rows = [(str(i), None if i % 10 == 0 else f"v{i % 7}", None, i % 2 == 0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "nct_id string, `a.b` string, none string, flag boolean, x double")
    got = features.distributions(df)["stats"]
    seen = [r[1] for r in rows if r[1]]
    want = sorted(set(seen), key=lambda v: (-seen.count(v), v))[:5]
    assert got["a.b"]["unique"] == 7 and list(got["a.b"]["top_values"].items()) == [(v, seen.count(v)) for v in want]
    assert got["none"] == {"unique": 0, "top_values": {}} and got["flag"] == {"unique": 2, "top_values": {"false": 30, "true": 30}} and list(got) == ["a.b", "none", "flag", "x"]
    assert "WindowGroupLimit" in features.value_counts(df, ["a.b", "flag"])._jdf.queryExecution().toString()


def test_content_hash_sends_little_to_the_driver(spark):
    """The chain is that of plain Python, over several partitions and ids out of order; what meets the driver is a fraction of the ids."""
    import hashlib

    from cohortline.operators import cohort

    n = 60_000
    ids = spark.range(0, n, 1, 7).select(F.concat(F.lit("NCT"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 8, "0")).alias("nct_id")).union(spark.createDataFrame([(None,), ("é,x",)], "nct_id string"))
    want = sorted([f"NCT{i:08d}" for i in range(n)] + ["é,x"])
    got = cohort.content_hash(ids).first()
    assert (got["content_hash"], got["n"]) == (hashlib.sha256(",".join(want).encode()).hexdigest()[:12], n + 1)
    sent = cohort.packed(ids.where("nct_id is not null").sort("nct_id")).agg(F.sum(F.length("pack"))).first()[0]
    assert sent < len(",".join(want)) / 3
    empty = cohort.content_hash(ids.where("false")).first()
    assert (empty["content_hash"], empty["n"]) == (hashlib.sha256(b"").hexdigest()[:12], 0)


def test_pairs_stay_in_their_cells(spark, monkeypatch):
    """One sponsor, names alike but never equal: every pair is counted, by likeness too, and a row an anchor and cell leaves the cells, not a row a pair."""
    import datetime

    from cohortline.operators import linkage

    start, rows = datetime.date(2010, 1, 1), []
    for i in range(240):
        day = start + datetime.timedelta(days=i)
        rows.append((f"N{i:03d}", i, "one", "PHASE2" if i % 2 else "PHASE3", "a; b" if i % 3 else "b; c", f"long compound {i:03d}; placebo" if i % 5 else " ; ", str(day), str(day), None, str(day)))
    t = spark.createDataFrame(rows, "nct_id string, ordinal long, lead_sponsor string, phases string, conditions string, intervention_names string, start_date string, primary_completion_date string, completion_date string, first_post_date string")
    a = t.where("phases = 'PHASE2'")
    near = lambda x, y: (x[5] == " ; ") == (y[5] == " ; ")
    want = {}
    for x in rows:
        for y in rows:
            if x[3] == "PHASE2" and y[3] == "PHASE3" and y[6] >= x[6] and near(x, y):
                n, first = want.get(x[0], (0, y[0]))
                want[x[0]] = (n + 1, first)
    for small in (20_000, 16):
        monkeypatch.setattr(linkage, "SMALL", small)
        got = {r["nct_id"]: (r["n_successors"], r["successor_id"]) for r in linkage.first_of(a, t).collect()}
        assert got == want
        left = linkage._links(a, t, 36, threshold=0.85, first=True).groupBy().agg(F.count(F.lit(1)), F.sum("n_successors")).first()
        assert left[1] == sum(n for n, _ in want.values()) > 4000 and left[0] <= 120 * 9
