"""BM25 over an index kept in DataFrames.

score = sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln((N - df + 0.5) / (df + 0.5)); a negative idf
becomes a quarter of the mean idf over all terms. Empty documents do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomgraph.functions import text
from loomgraph.operators import sparse
from loomgraph.sources import tables

K1, B = 1.5, 0.75


@dataclass
class Index:
    rows: DataFrame  # a document each: doc, and of its words terms, tfs, dls
    terms: DataFrame  # term, df
    n_docs: int
    avgdl: float
    mean_idf: float  # of the raw idf over all terms

    @property
    def postings(self) -> DataFrame:
        """(doc, term, tf, dl)."""
        return _postings(self.rows)


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select("doc", F.inline(F.arrays_zip("terms", "tfs", "dls"))).withColumnsRenamed({"terms": "term", "tfs": "tf", "dls": "dl"})


def _counted(batches):
    """(doc, words) to (doc, terms, tfs, dls); documents without words go."""
    for batch in batches:
        words = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
        row = key // size
        n = np.bincount(row, minlength=len(lengths))
        full = np.flatnonzero(n)
        ends = pa.array(np.concatenate([[0], np.cumsum(n[full])]).astype(np.int32))
        lists = [coded.dictionary.take(pa.array(key % size)), pa.array(tf.astype(np.int32)), pa.array(lengths[row].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=["doc", "terms", "tfs", "dls"])


def counts(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, terms, tfs, dls): of each row with words these, once each, how often they stand in it, and how many all of them are."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(body).alias("body"))
    schema = StructType([rows.schema["doc"], *(StructField(c, ArrayType(kind)) for c, kind in (("terms", StringType()), ("tfs", IntegerType()), ("dls", IntegerType())))])
    return tables.spread(rows).select("doc", text.tokens("body").alias("w")).mapInArrow(_counted, schema)


def build(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> Index:
    """Tokenizes the texts once, counts where they lie and writes a row for each document to the shared folder; three numbers come to
    the driver. Only rows that share an id are brought together."""
    counted = tables.cut(counts(docs, doc, body), "documents")
    again = tables.cut(counted.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("again")), "again")
    if not again.isEmpty():
        shared = F.col("doc").eqNullSafe(F.col("again"))
        summed = _postings(counted.join(again, shared, "left_semi")).groupBy("doc", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
        listed = summed.groupBy("doc").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("p")).select("doc", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("term", "tf", "dl")])
        counted = tables.cut(counted.join(again, shared, "left_anti").unionByName(listed), "documents")
    return of_rows(counted)


def of_rows(rows: DataFrame) -> Index:
    """The index over written rows."""
    # The shares tf / dl of a document sum to one, so their total is the number of documents.
    terms = tables.cut(_postings(rows).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum(F.col("tf") / F.col("dl")).alias("share")), "terms")
    total = terms.agg(F.round(F.sum("share")).cast("long").alias("n"), F.sum("tf").alias("tf")).first()
    n_docs = total["n"] or 0
    mean = terms.agg(F.avg(raw_idf(n_docs)).alias("mean")).first()["mean"]
    return Index(rows, terms.select("term", "df"), n_docs, (total["tf"] or 0) / max(n_docs, 1), mean or 0.0)


def save(index: Index, path: str) -> None:
    index.rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    return of_rows(spark.read.parquet(path))


def raw_idf(n_docs: int) -> Column:
    return F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def term_idf(index: Index) -> DataFrame:
    """(term, df, idf)."""
    return index.terms.withColumn("raw", raw_idf(index.n_docs)).select("term", "df", F.when(F.col("raw") < 0, F.lit(0.25 * index.mean_idf)).otherwise(F.col("raw")).alias("idf"))


def token_terms(queries: DataFrame, query: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """query_terms() of queries that are arrays of tokens already."""
    return queries.select(F.col(query).alias("query"), F.explode(tokens).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def query_terms(queries: DataFrame, query: str = "query_id", body: str = "text") -> DataFrame:
    """(query, term, times): a repeated term counts as often as it stands."""
    return token_terms(queries.select(query, text.tokens(body).alias("tokens")), query)


def _gain(index: Index, tf: Column, dl: Column) -> Column:
    """What a posting adds to a score for each unit of its term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(index.avgdl)))


def best(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best documents of query_terms() with a positive score. The queries' terms go to the
    documents, and only the best rows leave their task."""
    asked = tables.small(terms).join(term_idf(index), "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))
    points = index.rows.select("doc", "terms", F.zip_with("tfs", "dls", lambda tf, dl: _gain(index, tf, dl)).alias("weights"))
    return top(sparse.candidates(points, asked, k), k)


def top(scored: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """The k best of each query with their ranks. Ties go to the smaller id; scores are compared at 9 decimals, so that the
    order in which parts were added does not decide."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col(doc)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    return best(build(docs, doc), query_terms(queries, query), k)


def token_idf(index: Index, terms: DataFrame) -> DataFrame:
    """(term, idf_proxy): the largest score that the term alone gives any document; 0 where it gives none."""
    asked = tables.small(terms.select("term").distinct())
    part = _gain(index, F.col("tf"), F.col("dl"))
    gain = tables.cut(index.postings.join(asked, "term").groupBy("term").agg(F.max(part).alias("high"), F.min(part).alias("low")), "gain")
    alone = term_idf(index).join(tables.small(gain), "term").select("term", F.greatest(F.col("idf") * F.col("high"), F.col("idf") * F.col("low"), F.lit(0.0)).alias("best"))
    return terms.select("term").join(tables.small(tables.cut(alone, "alone")), "term", "left").select("term", F.coalesce("best", F.lit(0.0)).alias("idf_proxy"))
