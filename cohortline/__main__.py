"""Stages by command: python -m cohortline STAGE ... Each reads and writes tables by path, so stages are joined by files alone."""

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortline.operators import audit, cohort, features, labels, metrics, models, snapshots, splits, text
from cohortline.sources import registry_json, rest, storage

log = logging.getLogger("cohortline")


def setup_logging(level: str = "INFO") -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohortline", description=__doc__)
    p.add_argument("--log-level", default="INFO")
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, *args: tuple[str, dict]):
        s = sub.add_parser(name)
        for flag, how in args:
            s.add_argument(flag, **how)

    out = ("--output", {"required": True})
    studies = ("--studies", {"required": True, "help": "Parquet of flat studies"})
    stage("ingest", out, ("--tag", {"default": "pull"}), ("--statuses", {"default": "COMPLETED,TERMINATED,WITHDRAWN"}), ("--phases", {"default": "PHASE1,PHASE2,PHASE3"}), ("--max-studies", {"type": int}), ("--page-size", {"type": int, "default": rest.MOST_A_PAGE}), ("--delay", {"type": float, "default": 1.2}), ("--client", {"default": "cohortline.sources.rest:urlopen_json"}), ("--slices", {"default": ""}), ("--pages", {"help": "a shared folder that keeps this pull's pages"}))
    stage("flatten", ("--raw", {"required": True}), out, ("--output-format", {"choices": ["parquet", "csv"], "default": "parquet"}))
    stage("cohort", studies, out, ("--config", {"help": "YAML; the standard cohort by default"}), ("--tag", {"default": "cohort"}))
    stage("labels", studies, ("--cohort", {"required": True}), out, ("--reference", {"required": True, "help": "YYYY-MM-DD"}), ("--min-followup", {"type": int, "default": 36}))
    stage("features", studies, out, ("--timepoint", {"choices": snapshots.TIMEPOINTS, "default": "T0"}), ("--structured-config", {"help": "YAML"}), ("--text-config", {"help": "YAML"}))
    stage("train", studies, ("--labels", {"required": True}), out, ("--benchmark", {"choices": [b.name for b in splits.LADDER], "default": "strict"}), ("--model", {"choices": ["logistic", "gbt"], "default": "logistic"}),
          ("--features", {"choices": ["structured", "text", "fusion"], "default": "structured"}), ("--train-end", {"default": "2017-12-31"}), ("--val-end", {"default": "2019-12-31"}), ("--label-task", {"default": labels.TASK_OF_TYPE["development"]}),
          ("--bootstrap", {"type": int, "default": 0}), ("--inspect", {"action": "store_true"}), ("--today", {"help": "YYYY-MM-DD; the current date by default"}), ("--config", {"help": "YAML with the model's params"}),
          ("--grid", {"action": "store_true", "help": "every experiment of the standard grid; one that fails is noted and the others go on"}))
    stage("audit", studies, ("--labels", {"required": True}), out, ("--phase", {"default": "PHASE2"}), ("--label-task", {"default": labels.TASK_OF_TYPE["development"]}), ("--n-positive", {"type": int, "default": 50}), ("--n-negative", {"type": int, "default": 50}), ("--n-edge", {"type": int, "default": 25}))
    return p


def make_features(spark: SparkSession, studies, a: argparse.Namespace) -> list[str]:
    """Structured features, TF-IDF weights and the fitted vocabulary, which can be read again, and a description of them."""
    structured_config, text_config = (storage.load_config(c) if c else None for c in (a.structured_config, a.text_config))
    registry = features.Registry.from_configs(structured_config, text_config) if structured_config else features.Registry.standard()
    snap = snapshots.snapshot(studies, a.timepoint)
    dense = storage.save(features.structured(snap, registry), f"{a.output}/structured_{a.timepoint}")
    docs = snap.select("nct_id", features.document_by_field(*[F.col(f.source_column) for f in registry.by_type("text_source") if f.source_column in snap.columns]).alias("doc"))
    config = text.TfidfConfig.from_config((text_config or {}).get("tfidf") or {})
    vocabulary = storage.save(text.fit(docs, "doc", config), f"{a.output}/vocabulary_{a.timepoint}")
    index = text.indexed(spark.read.parquet(vocabulary))
    weights = storage.save(text.weights(docs, index, "nct_id", "doc", config), f"{a.output}/tfidf_{a.timepoint}")
    table = spark.read.parquet(dense)
    spread, missing = features.distributions(table), features.missing_report(table)
    about = {"timepoint": a.timepoint, "n_trials": table.count(), "structured_features": len(table.columns) - 1, "tfidf_features": index.count(), "tfidf": vars(config),
             "constant_columns": spread["constant_columns"], "high_cardinality": spread["high_cardinality"], "high_missing_features": [{"name": n, "rate": r} for n, r in missing["flagged"]], "timestamp": storage.stamp()}
    return [dense, vocabulary, weights, storage.save_json(spark, about, f"{a.output}/feature_meta_{a.timepoint}.json")]


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda path: storage.load(spark, storage.latest(spark, path) if "*" in path else path)
    if a.stage == "ingest":
        spark.dataSource.register(rest.RegistryApi)
        options = {"statuses": a.statuses, "phases": a.phases, "pagesize": str(a.page_size), "delay": str(a.delay), "client": a.client, "slices": a.slices} | ({"pages": a.pages} if a.pages else {}) | ({"maxstudies": str(a.max_studies)} if a.max_studies else {})
        log.info("wrote %s", storage.save_raw(spark, spark.read.format("registry_api").options(**options).load(), a.output, a.tag))
    elif a.stage == "flatten":
        log.info("wrote %s", storage.save(registry_json.flatten(registry_json.read_raw(spark, a.raw)), a.output, a.output_format))
    elif a.stage == "cohort":
        config = cohort.CohortConfig.from_dict(storage.load_config(a.config)) if a.config else cohort.STANDARD
        kept, out, meta = cohort.build_cohort(read(a.studies), config)
        log.info("wrote %s", storage.save_cohort(kept, out, {"built": storage.stamp(), **meta}, a.output, a.tag))
    elif a.stage == "labels":
        members = read(a.cohort)
        path = storage.save(labels.build(members, read(a.studies), F.lit(a.reference).cast("date"), a.min_followup), f"{a.output}/labels_{storage.stamp()}")
        out = storage.load(spark, path)  # the other files come from the table, not from the plan again
        log.info("wrote %s", [path, *storage.save_label_files(out, {"built": storage.stamp(), **labels.audit(out, members.count())}, path.removesuffix(".parquet")), storage.save(labels.wide(out), path.replace("labels_", "labels_wide_"), "csv")])
    elif a.stage == "features":
        log.info("wrote %s", make_features(spark, read(a.studies), a))
    elif a.stage == "train":
        t, lab = read(a.studies), labels.with_events(labels.with_task(read(a.labels)))
        today = F.lit(a.today).cast("date") if a.today else None
        date = splits.date_column(t)
        if a.inspect:
            for r in splits.yearly(splits.dataset(lab, t, a.benchmark, date, a.label_task, today=today), t, date).orderBy("year").collect():
                log.info("%s", r.asDict())
            return
        folder, snap = storage.output_folder(a.output, a.label_task), snapshots.snapshot(t, "T0")
        split = lambda name: splits.temporal_split(splits.dataset(lab, t, name, date, a.label_task, today=today), t, a.train_end, a.val_end, date)
        grid = models.GRID if a.grid else [{"model": a.model, "features": a.features, "benchmark": a.benchmark}]
        parts = {n: split(n) for n in sorted({g["benchmark"] for g in grid})}
        if a.grid:
            results, failures = models.run_grid(parts, snap, grid, a.bootstrap, folder)
        else:
            results, failures = models.run_experiment(grid[0], parts[a.benchmark], snap, a.bootstrap, storage.load_config(a.config) if a.config else None, folder), []
        for r in results:
            storage.save_evaluation(spark, r, folder)
            log.info("%s", metrics.summary(r))
        for f in failures:
            log.warning("failed: %s", f)
        storage.save_json(spark, {"label_task": a.label_task, "splits": {n: splits.summary(p, date, a.train_end, a.val_end) for n, p in parts.items()}, "failures": failures}, f"{folder}/split_summary.json")
        storage.save_text(spark, metrics.comparison(results), f"{folder}/comparison.md")
    elif a.stage == "audit":
        t = read(a.studies)
        dev = labels.with_events(labels.with_task(read(a.labels))).where("label_type = 'development'")
        dev = dev if "phases" in dev.columns else dev.join(t.select("nct_id", "phases"), "nct_id", "left")
        dev = audit.in_phase(dev.where(F.col("label_task") == a.label_task), a.phase)
        got = audit.sample(dev, audit.targets(a.n_positive, a.n_negative, a.n_edge)).drop("phases")
        log.info("wrote %s", storage.save_review(audit.review(got, t, ["audit_bucket", *audit.REVIEW_COLUMNS]), f"{a.output}/audit_{storage.stamp()}.csv"))
        for name in ("event_label", "event_category"):  # of the whole set, not of the sample
            log.info("%s: %s", name, {r["value"]: r["n"] for r in audit.distribution(dev, name).collect()})


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    setup_logging(a.log_level)
    spark = SparkSession.builder.appName(f"cohortline-{a.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, a)


if __name__ == "__main__":
    main()
