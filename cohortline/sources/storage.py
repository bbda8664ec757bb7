"""Tables and side files by path, through Spark, so that any store that Spark reads will do."""

import gc
import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet or CSV table by its suffix."""
    if not path.endswith((".parquet", ".csv")):
        raise ValueError(f"neither .parquet nor .csv: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def save(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Writes a table, its suffix following the format; returns the path."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    for s in (".parquet", ".csv"):
        path = path.removesuffix(s)
    path = f"{path}.{fmt}"
    writer = df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).option("escape", '"').csv(path)
    return path


def latest(spark: SparkSession, pattern: str) -> str:
    """The last path, by name, of those that match."""
    fs, p = _fs(spark, pattern)
    found = sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))
    if not found:
        raise FileNotFoundError(pattern)
    return found[-1]


def save_text(spark: SparkSession, text: str, path: str) -> str:
    """A small file that the driver writes."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path


def save_json(spark: SparkSession, value, path: str) -> str:
    return save_text(spark, json.dumps(value, indent=2, ensure_ascii=False, default=str), path)


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def save_raw(spark: SparkSession, records: DataFrame, folder: str, tag: str = "pull", source: str = "registry_api") -> str:
    """A pull (column `record`: JSON text) as JSON lines, with its envelope beside it; the records never meet on the driver."""
    at = stamp()
    path = f"{folder}/raw_{tag}_{at}"
    records.select("record").write.text(f"{path}.jsonl")
    save_json(spark, {"source": source, "pull_timestamp": at, "study_count": spark.read.text(f"{path}.jsonl").count(), "tag": tag}, f"{path}.metadata.json")
    return f"{path}.jsonl"


def save_review(df: DataFrame, path: str) -> str:
    """A small table as one CSV file with a byte-order mark and every field quoted, as spreadsheets want it."""
    quote = lambda v: '"' + ("" if v is None else str(v)).replace('"', '""') + '"'
    lines = [",".join(map(quote, df.columns))] + [",".join(map(quote, r)) for r in df.toLocalIterator()]
    return save_text(df.sparkSession, "﻿" + "\r\n".join(lines) + "\r\n", path)


def save_cohort(cohort: DataFrame, excluded: DataFrame, meta: dict, folder: str, tag: str = "cohort") -> dict[str, str]:
    at, spark = stamp(), cohort.sparkSession
    log = excluded.select("nct_id", "exclusion_reason")
    return {"cohort": save(cohort, f"{folder}/{tag}_{at}"), "exclusions": save(log, f"{folder}/{tag}_exclusions_{at}", "csv"),
            "metadata": save_json(spark, meta, f"{folder}/{tag}_metadata_{at}.json")}


def save_snapshots(snapshots: dict[str, DataFrame], meta: dict, folder: str) -> list[str]:
    at = stamp()
    paths = [save(df, f"{folder}/snapshot_{t}_{at}") for t, df in snapshots.items()]
    return [*paths, save_json(next(iter(snapshots.values())).sparkSession, meta, f"{folder}/snapshots_metadata_{at}.json")]


def save_label_files(labels: DataFrame, audit: dict, stem: str) -> list[str]:
    """The label table once more as CSV, and its audit."""
    return [save(labels, stem, "csv"), save_json(labels.sparkSession, audit, f"{stem}_audit.json")]


def save_evaluation(spark: SparkSession, result: dict, folder: str) -> str:
    name = "eval_{model}_{features}_{benchmark}_{split}.json".format(**result)
    return save_json(spark, result, f"{folder}/{name}")


def output_folder(folder: str, task: str) -> str:
    """Runs are kept apart by task and time, unless the folder is a benchmark's own."""
    return folder if "benchmarks" in folder else f"{folder}/{task}/{stamp()}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one is made only for a session that runs on this machine alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='cohortline-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


#: Under this setting Spark removes what a query has shuffled when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, *more: DataFrame) -> str:
    """Writes df, and then each of `more`, as one Parquet table of this application in the shared folder; the file system removes it when the application's JVM ends, however that comes
    about. What a frame has shuffled goes as soon as it is written, so frames that are given one by one never need the disk at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohortline-stages/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}.parquet"
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())  # of what exists
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for x in (df, *more):
            x.write.mode("append").option("compression", "zstd").parquet(path)
    except Exception:
        remove(spark, path)  # a table is whole or not there
        raise
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def size_of(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in set(df.inputFiles())]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def state_of(df: DataFrame) -> str:
    """A digest of all that df is made of: its plan, and the names, sizes and times of the files that it reads."""
    spark, digest = df.sparkSession, hashlib.sha256(f"{df.semanticHash()} {df.schema.simpleString()}".encode())
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in sorted(set(df.inputFiles())):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        found = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{name} {found.getLen()} {found.getModificationTime()}\n".encode())
    return digest.hexdigest()


_staged: dict[tuple, str] = {}
_staging = threading.Lock()


def staged(spark: SparkSession, name: tuple, build: Callable[[], DataFrame | list[DataFrame]], *inputs: DataFrame) -> DataFrame:
    """The table that `build` gives (with named inputs, also in several frames, which are written one by one), written once for each state of what it is made from and read from there, as the output of a stage is.

    That state is the plan and the files (names, sizes, times) of the inputs that are named, or else of the table that `build` describes: where an input was rewritten or the
    computation is another one, the table is made anew. Frames that read an older table go on doing so; all of them go when the application ends, `unstage` removes them before."""
    made = None if inputs else build()
    key = (spark.sparkContext.applicationId, *name, *(state_of(df) for df in inputs or (made,)))
    with _staging:
        if key not in _staged or not exists(spark, _staged[key]):
            made = build() if made is None else made
            _staged[key] = stage_table(*(made if isinstance(made, list) else [made]))
            # what the stage has shuffled is of no more use; Spark removes it when the driver has collected its garbage
            made = None
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        return spark.read.parquet(_staged[key])


def unstage(spark: SparkSession, *name) -> int:
    """Removes this application's staged tables whose names start so (all of them, without one); returns how many there were."""
    head = (spark.sparkContext.applicationId, *name)
    with _staging:
        gone = [k for k in _staged if k[:len(head)] == head]
        for k in gone:
            remove(spark, _staged.pop(k))
    return len(gone)
