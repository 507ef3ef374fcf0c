"""A corpus pipeline of five stages over ``documents``.

Every stage takes what its predecessor kept, whole, and is written as Parquet
before the next one reads it.  All but the last return the columns of
``documents``; the last writes token shards and returns their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import decontam, langid, mixing, near_dup, token_shards
from barlake.llm.shared import bounded_batches, dropped, stored

#: A text of which less than this share of n-grams belongs to any language is rejected.
LEAST_LANGUAGE = 0.3
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or in no known language go.

    Each row is judged by its own text: nulls and empty texts go, equal rows
    fare alike, an id decides nothing but whether its row is in the sample.
    """
    bounded_batches(spark)
    return langid.accepted(docs, langid.fit(docs), LEAST_LANGUAGE)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, rows without id last.

    Of rows equal in id and text one stays.  Texts without words are no copies
    of one another.
    """
    bounded_batches(spark)
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stand in passages of the benchmark go.

    Each row is judged by its own text; null and word-less texts stay.
    """
    bounded_batches(spark)
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them.

    The hash of a row's id and text decides, so rows of a source that are equal
    in both are taken alike; a text without words counts nothing and follows the
    same rule.
    """
    plan = mixing.thresholds(stored(mixing.sizes(docs), "sizes"))
    h = mixing.hash60(F.col("doc_id"), F.col("text"))
    rows = docs.select("source", h.alias("h"), F.struct(*docs.columns).alias("row"))  # whatever its columns are called
    taken = mixing.with_copies(rows, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order; a null or empty text is its end id alone."""
    bounded_batches(spark)
    return token_shards.materialise(docs, TOKENIZER)


STAGES = [
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    out = stored(STAGES[-1][1](spark, docs, sf_dir), "stage-tokens")
    dropped(before)
    return out
