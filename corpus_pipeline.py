"""Corpus pipeline: from raw documents to a clean, mixed training corpus, in five stages that each apply one operator.

Every stage works on all documents that the one before it kept, and is written as Parquet and read again. All but the last
return the columns of documents; the last adds how often the mix takes a document. Documents are judged row by row or in
groups with one result, so nulls, empty texts, repeated rows and extra columns pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm import bytecnn, hyperminhash, mixing, suffixes, wordcnn
from glossweave.llm.learning import id_remainder
from glossweave.llm.rows import own_names, with_plain_names
from glossweave.session import materialise, table

QUALITY, TOXICITY = 0.3, 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more. The classifier is fitted on labelled rows outside its held-out fifth."""
    model = bytecnn.fit_quality(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0, threshold=QUALITY)
    plain, names = with_plain_names(docs)
    return own_names(bytecnn.score(plain, model, names["text"], tuple(names.values()), QUALITY).filter("predicted = 1"), names)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below their language's calibrated threshold, or below 0.7 where it has none.

    The classifier is fitted on labelled rows outside its held-out third.
    """
    model = wordcnn.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 3) != 1, threshold=TOXICITY)
    plain, names = with_plain_names(docs)
    return own_names(wordcnn.score(plain, model, names["text"], tuple(names.values()), names["lang"]).filter("NOT flagged"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return hyperminhash.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words inside occurrences of 13-word windows of benchmark items."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, repeats and taken. Sources weigh 1, 2, 3, repeating."""
    return mixing.mix(docs).filter("repeats > 0")


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]
#: The classifiers cannot be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
