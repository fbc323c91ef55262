"""A cleaning run over `documents`: toxicity, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, line_dedup, near_copies, scratch, toxicity
from loomgraph.llm.queries import RANKS, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go. It learns from the labels of documents that are here."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in one of them. Texts that lose nothing, nulls
    among them, stay as they are."""
    return line_dedup.without_common_lines(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Texts link if the Jaccard similarity of their
    five-word shingles is 0.8 or more, by their shingles themselves; segments of wide SimHashes find the candidates. Null and
    wordless texts are nobody's copies."""
    groups = near_copies.near_copies(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go: a copied passage comes from one item. (The column `contaminated`
    of op3 asks for two.)"""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of the documents that are left."""
    import public_tokenizers

    encoded = bpe.encode(docs, str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_common_lines), ("simhash", without_near_copies), ("decontamination", without_benchmark), ("bpe", tokens)]

#: SQL can express neither the fitted model, nor XXH64, nor BPE merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
