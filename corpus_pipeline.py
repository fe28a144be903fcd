"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

1. toxicity: documents that the toxic-passage score rejects go.
2. near_dedup: one document of each group of near copies stays.
3. secrets: every secret span is masked; no document goes.
4. mix: each document is dropped, kept or repeated, so that the sources meet their target weights.
5. pack: what is left becomes token sequences of at most 2,048 tokens, one row for each piece.

Edge cases are those of the operators; a stage that gets no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumi.llm import minhash, mixing, packing, secret_scan, toxicity
from sumi.llm.base import materialize, times

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the limit of rejection, with all their columns; repeated rows share their fate. Rows
    carry their columns through the scoring pass, so nothing is joined or moved. No rows give no rows."""
    scored = toxicity.score(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one of the smallest id (a null id is last); of repeated rows one stays."""
    docs = docs.select(*COLUMNS)
    grouped = materialize(minhash.near_duplicates(docs), "near-duplicates")
    gone = grouped.where(~F.col("kept")).select("row_key").distinct()
    plan = grouped.join(gone, "row_key", "left_semi").select("row_key", F.col("kept").cast("int").alias("copies"))
    return times(docs, plan).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; every secret span of a text is masked and n_chars follows; null and empty texts stay as they are."""
    masked = secret_scan.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are never taken; repeated rows are drawn each on
    their own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; a null or empty text is one piece that holds the end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Learned scores, sampling hashes and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
