"""What large tables ask of the steps that the queries share: the same rows, less on disk, no work by row in Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortline.operators import labels
from cohortline.plans import queries, trial_adapter
from cohortline.sources import registry_json, storage

SF = "/root/testdata/sf0.001"


def shuffled(spark) -> int:
    """Shuffle files that are on this machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stage_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    path = storage.stage_table(df, df.where("k < 3"))
    assert shuffled(spark) <= before and spark.read.parquet(path).count() == 7 + 3
    assert spark.conf.get(storage.CLEANUP, "false") == "false"  # as it was


def test_a_stage_of_several_frames_is_whole_or_not_there(spark):
    parts = lambda bad: [spark.range(3), spark.range(2).select((F.lit(6) / (F.col("id") + (0 if bad else 1))).cast("long").alias("id"))]
    assert storage.staged(spark, ("test", "parts"), lambda: parts(False), spark.range(1)).count() == 5
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        storage.staged(spark, ("test", "bad"), lambda: parts(True), spark.range(1))
    assert storage.unstage(spark, "test", "bad") == 0 and storage.unstage(spark, "test", "parts") == 1


def test_slices_of_the_studies_are_all_of_them(spark, monkeypatch):
    whole = sorted(map(str, trial_adapter.view(spark, SF).collect()))
    parts = [trial_adapter.view(spark, SF, i, 3).collect() for i in range(3)]
    assert all(parts) and sorted(str(r) for p in parts for r in p) == whole
    monkeypatch.setattr(trial_adapter, "SLICE_BYTES", 1)
    storage.unstage(spark, "trials", SF)
    assert sorted(map(str, trial_adapter.trials(spark, SF).select(*trial_adapter.COLUMNS).collect())) == whole
    storage.unstage(spark, "trials", SF)


def test_common_assets_frequent_and_not(spark, monkeypatch):
    """Names in most rows, in just enough, in too few, and none: the flag is that of counting, however many names are frequent."""
    names = [["a", "b"], ["A; c1"], [], ["rare", "x"], ["c2"], ["y;  c1"]]
    rows = [(f"N{i}", "; ".join(names[i % 6]) or None) for i in range(90)] + [(f"M{i}", f"z{i // 3}; w{i // 12}") for i in range(60)]
    tokens = lambda s: {t.strip().lower() for t in (s or "").split(";")} - {""}
    n = Counter(t for _, s in rows for t in tokens(s))
    studies = spark.createDataFrame(rows, "nct_id string, intervention_names string")
    for shares in (1, 8, 1024):
        monkeypatch.setattr(labels, "SHARES", shares)
        for least in (10, 15, 16, 1000):
            got = {r["nct_id"]: r["common_asset_flag"] for r in labels.with_common_asset(studies, studies, least).collect()}
            assert got == {k: any(n[t] >= least for t in tokens(s)) for k, s in rows}


@pytest.mark.parametrize("fuzzy", [False, True])
def test_slices_of_the_sponsors_give_all_labels(spark, monkeypatch, fuzzy):
    """Sponsors without a name too, and names counted over all studies: the slices together are the labels of the whole."""
    t = trial_adapter.trials(spark, SF)
    whole = sorted(map(str, labels.development(t, t, fuzzy=fuzzy).collect()))
    a, names = queries.anchored(spark, SF), labels.intervention_counts(t)
    parts = [p.collect() for p in labels.development_slices(t, t, 3, a, names, fuzzy=fuzzy)]
    assert all(parts) and sorted(str(r) for p in parts for r in p) == whole
    monkeypatch.setattr(trial_adapter, "SLICE_BYTES", 1 << 14)
    storage.unstage(spark, "development", SF)
    assert trial_adapter.slices(t) > 1 and sorted(map(str, queries.development(spark, SF, fuzzy).collect())) == whole
    storage.unstage(spark, "development", SF)


def test_only_the_last_of_an_id_is_parsed(spark):
    """Records as texts: the rows of all parsed first; ids that repeat inside a file and over files, or are missing."""
    raw = queries.nested_records(spark, SF).withColumn("record", F.when(F.col("ordinal") % 50 == 0, "{}").otherwise(F.regexp_replace("record", "NCT0000(\\d)\\d\\d", "NCT0000$100")))
    parsed = raw.select("file", "ordinal", F.from_json("record", registry_json.record()).alias("study"))
    want = {}
    for r in parsed.select("file", "ordinal", *[c.alias(n) for n, c in registry_json.columns("study").items()]).collect():
        want[r["nct_id"]] = max(want.get(r["nct_id"], r), r, key=lambda x: (x["file"], x["ordinal"]))
    names = ["ordinal", *registry_json.columns("study")]
    assert 1 < len(want) < raw.count() / 5 and None in want
    for one in (raw, parsed):
        got = registry_json.flatten(one)
        assert got.columns == names and sorted(map(str, got.collect())) == sorted(str(r) for r in parsed.sparkSession.createDataFrame([tuple(w[n] for n in names) for w in want.values()], got.schema).collect())
    plan = registry_json.flatten(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Aggregate")  # above it: after it
