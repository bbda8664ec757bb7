"""One query per operator, over whole tables, with the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import bpe, circulant_minhash, exact_dedup, jaccard_forest, langid, order_minhash, packing, periodic_runs, pii, quality, ranked_search, sharding, toxicity
from cohortline.llm.common import read_table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), ranks_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), ranks_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.5)


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_dedup(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(read_table(spark, sf_dir, "documents"), edit=periodic_runs.planted))


QUERIES = {f.__name__: f for f in (op1_pii, op2_jaccard_join, op3_bpe, op4_exact_dedup, op5_language_id, op6_fingerprints, op7_quality, op8_sharding, op9_packing, op10_toxicity,
                                    op11_near_dedup, op12_ranked_search, op13_periodic_runs)}
SQL = {"op4_exact_dedup": exact_dedup.SQL, "op11_near_dedup": circulant_minhash.SQL, "op12_ranked_search": ranked_search.SQL}
