"""What the corpus operators share: whole null-safe texts, written stages, the fold rule and bounded samples."""

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker; a batch from Arrow is walked in slices of this many rows.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slim(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Only (doc_id, text), so other columns, whatever their names, never clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is made only where the session names none and runs on this machine alone, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='cohortline-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    for spark, path in _stages:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001, S110  (the session has ended, and its folder with it or not: nothing is left to do)
            pass


_scope: ContextVar[list | None] = ContextVar("scope", default=None)
_stages: list[tuple[SparkSession, str]] = []
atexit.register(_at_exit)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing. Lazy results read these tables
    as long as the application runs; its end removes them, `remove` does so before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stages.append((spark, path))
    if (made := _scope.get()) is not None:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """The tables that are written inside, as a list that grows: for callers that write out what they made of them and then `remove` them."""
    made: list[tuple[SparkSession, str]] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)


def remove(tables: list[tuple[SparkSession, str]]) -> None:
    for gone in tables:
        _remove(*gone)
        if gone in _stages:
            _stages.remove(gone)


def in_training_fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is not 0."""
    return (F.crc32(id_col.cast("string")) % 5) != 0


def held_out(id_col: Column) -> Column:
    return F.coalesce((F.crc32(id_col.cast("string")) % 5) == 0, F.lit(False))


def hashed_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if it has no more), chosen by a hash of the key: the same ones each time."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * rows / n))


def pieces(batch, size: int = SLICE):
    """An Arrow batch in slices, so that Python never holds a whole batch of texts as objects."""
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)
