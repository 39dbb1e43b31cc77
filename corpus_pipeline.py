"""The corpus pipeline: each stage takes what the one before it kept, as a table of documents, and its decisions take effect.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.

Null and empty texts are texts like any other: they score as no evidence, are copies of one another, hold no
benchmark item and have no ids. A null identifier loses to any other. Of rows repeated with identifier and text one
stays. An empty table gives an empty result. Documents may have any columns beside doc_id and text, but for names
that begin with two underscores, which are the stages' own. Stage tables are left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from quarry.llm.common import new_folder, table
from quarry.llm.queries import vocabulary_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents at or over the cut go. Trained on the labelled rows of docs that aren't held out."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8's links, and those of texts whose five-word shingles have a similarity of 0.8: of what is linked the row with the smallest doc_id stays."""
    return near_copies.deduplicated(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents in which a benchmark item is found go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens, ids and the digests of ids and of the text decoded from them."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_copies_out),
    ("simhash near-dedup", near_copies_out),
    ("benchmark decontamination", leaks_out),
    ("bpe", encoded),
]

#: The classifier's and the fingerprints' decisions are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at := new_folder(spark, f"stage-{k}"))
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
