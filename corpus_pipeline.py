"""A corpus pipeline: five stages from web documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again
as the docs of the next. The stages decide on their own input: rejected documents go, one
of each near-duplicate class stays, passages that an earlier document has are cut out,
secrets are replaced, and what is left is packed into sequences of token ids.

Null texts count as empty: the classifier scores them like any other, of all texts without
words one stays, and such a document is a piece of just the end mark. A null doc_id keeps its
row: one row of each near-duplicate class without id stays, nothing is cut out of it, and its
piece has a null doc_id. Rows that repeat a doc_id are one document after the second stage. Of
ties the least doc_id stays, and the earliest occurrence of a passage. Texts of any length are
read whole; ones longer than a sequence are split by the packer. Empty tables pass through; a
table without positive labels rejects nothing. Further columns, whatever their names, come
along up to the packer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailhead.llm import base, neardup, packing, quality, secrets, suffixes
from trailhead.llm.queries import END_ID, ranks_and_pattern


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.train(docs, base.table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_apart(docs, *ranks_and_pattern(), end_id=END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: None: a classifier, sketches and a packer can't be put in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.materialise(stage(spark, docs, sf_dir), name)
    return docs
