"""Exact dedup by skew-safe combining, with DataFrame operations only.

Three stages, each grouping by the digest *and* the full text, so that a digest collision never merges two texts:
1. every task combines its own rows (the map side of the first aggregate);
2. the partial winners of a (digest, text) meet in one of `salts` salted groups, the salt being the task they came from,
   so a text that fills a third of the corpus sends at most one row a task;
3. the salt winners of a (digest, text) are combined globally: at most `salts` rows each.
Texts are compared whole wherever groups are made. Decisions, which are small rows, go back to the documents by two digests of different families over the
same whole text (SHA-256 and xxHash64, 320 bits together), so that no text is shuffled a third time.

Defined results: a null text is the empty text; a null doc_id is the smallest; of rows that repeat both doc_id and text one is kept
and the others are dropped; an empty table gives an empty table; columns other than doc_id and text do not matter, whatever their types and names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.common import whole_text

SALTS = 32


def _digested(docs: DataFrame, text_col: str, id_col: str, *rest) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *rest).withColumn("digest", F.sha2("text", 256))


def combine(rows: DataFrame, best: Column, salts: int = SALTS, order: Column | None = None) -> DataFrame:
    """One row (digest, text, win, n) a text: `best` is the expression whose largest value wins; by `order`, if its own type has none."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    if order is not None:
        salted = salted.withColumn("win", best).withColumn("by", order)
        local = salted.groupBy("digest", "text", "salt").agg(F.max_by("win", "by").alias("win"), F.max("by").alias("by"), F.count(F.lit(1)).alias("n"))
        return local.groupBy("digest", "text").agg(F.max_by("win", "by").alias("win"), F.sum("n").alias("n"))
    local = salted.groupBy("digest", "text", "salt").agg(F.max(best).alias("win"), F.count(F.lit(1)).alias("n"))
    return local.groupBy("digest", "text").agg(F.max("win").alias("win"), F.sum("n").alias("n"))


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared: maps and variants can't, nor what holds them."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digested(docs, text_col, id_col)
    classes = combine(rows, F.col("doc_id"), salts)
    # a text met once is its own winner: only repeated texts go back to the rows, dealt over the salts
    repeated = classes.where("n > 1").select("digest", F.xxhash64("text").alias("other"), "win", F.col("n").alias("size"))
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    back = (rows.select("doc_id", "digest", F.xxhash64("text").alias("other"))
            .groupBy("doc_id", "digest", "other").agg(F.count(F.lit(1)).cast("int").alias("times"))
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))
    joined = back.join(repeated, ["digest", "other", "salt"], "left")
    turn = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("win"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "digest", turn).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


def survivors(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows that stay, whole and with all their columns: the same combining, the row itself being what wins."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    # columns go by place, so that no name clashes
    rest = F.struct(F.col(text_col).isNotNull().alias("has_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = _digested(docs, text_col, id_col, rest.alias("rest"))
    able = [f"c{i}" for i, c in enumerate(others) if _ordered(docs.schema[c].dataType)]
    order = F.struct(F.col("doc_id"), *[F.col(f"rest.{c}") for c in able]) if len(able) < len(others) else None
    won = combine(rows, F.struct(F.col("doc_id"), F.col("rest")), salts, order)
    cols = {id_col: F.col("win.doc_id"), text_col: F.when(F.col("win.rest.has_text"), F.col("text"))} | {c: F.col(f"win.rest.c{i}") for i, c in enumerate(others)}
    return won.select(*[cols[c].alias(c) for c in docs.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
