"""The training-data pipeline over `documents`: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm import jaccard, packing, quality, recipes, secrets
from voxweave.llm.common import cut, release


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (one column, doc_id); a null matches a null."""
    name = next(n for n in ("_id" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    ids = ids.select(F.col("doc_id").alias(name)).distinct().hint("shuffle_hash")
    return docs.join(ids, docs.doc_id.eqNullSafe(F.col(name)), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that repeat doc_id and text, one."""
    kept = recipes.exact_dedup(docs).where("kept").select("doc_id")
    return _only(docs, kept).dropDuplicates(["doc_id", "text"])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8 or more) stays; those without a doc_id stay."""
    kept = jaccard.near_components(docs, 5, 80, 100).where("doc_id <=> component_id").select("doc_id")
    return _only(docs, kept)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in them is replaced, and n_chars is counted again."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, with their ids."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]
#: A trained model, links by set similarity and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            release(before)
    return docs
