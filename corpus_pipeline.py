"""Training-data pipeline over ``documents``: each stage calls one operator of
``crowdtally.llm``; its result is written as Parquet and reread as the next one's input.

1. toxicity: documents predicted toxic go;
2. SimHash near-dedup: one document of each group (the smallest doc_id) stays;
3. benchmark decontamination: contaminated documents go, hit spans of others are cut;
4. PII: personal data is replaced by its kind;
5. byte-level BPE: token counts and digests of what is left.

A stage that changes texts sets ``n_chars`` to their new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtally.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from crowdtally.llm.common import read, shared_folder


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte-level bpe", bpe_stage),
]

#: No SQL form (trained models, tokenizer merges); tests/llm/test_pipeline.py checks every
#: stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
