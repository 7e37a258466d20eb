"""Five stages over documents: quality rules, near-duplicate removal, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of documents. run() writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import op3_mix, op4_jaccard, op6_pii, op8_bpe, op9_quality
from pagetide.llm.queries import tokenizer_path
from pagetide.llm.shared import cut, documents, remove, scratch, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fixed rules or the outlier test reject."""
    return op9_quality.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest id) of each group linked by five-word shingles at 0.8 or more."""
    found = op4_jaccard.jaccard_components(docs.select("doc_id", "text"), words=5, num=80, den=100)
    drop = cut(found.where("component_id <> doc_id").select("doc_id").distinct())
    return without(docs, drop, "doc_id")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind."""
    return op6_pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix of sources does, up to three times."""
    return op3_mix.mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of ids and decoded text."""
    return op8_bpe.encode(docs, tokenizer_path(), keys=("doc_id", "lang", "source"))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", jaccard_join), ("pii", personal_data), ("source_mix", source_mix), ("bpe", bpe)]

#: Iterative estimates and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # nothing reads a stage's table once the next one is written
        before = path
    return docs
