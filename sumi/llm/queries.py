"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, sharding
from .base import documents

SMALL_LIMIT = 64 << 10


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import compare_next

    return compare_next(documents(spark, sf_dir))


def op4_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import report

    return report(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def extendible_shards_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a limit that makes small tables split, several levels deep."""
    return sharding.shards(documents(spark, sf_dir), SMALL_LIMIT)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("row_key")


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_token_counts": op2_token_counts,
    "op3_lz_fingerprints": op3_lz_fingerprints,
    "op4_toxic_passages": op4_toxic_passages,
    "op5_source_mix": op5_source_mix,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_extendible_shards": op8_extendible_shards,
    "extendible_shards_64k": extendible_shards_64k,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_groups": op10_minhash_groups,
}
ORACLES: dict[str, str] = {
    "op5_source_mix": mixing.SQL,
    "op8_extendible_shards": sharding.sql(sharding.LIMIT_BYTES),
    "extendible_shards_64k": sharding.sql(SMALL_LIMIT),
}
