"""Dense and sparse vector search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.functions import vectors
from loomgraph.operators import bm25, sparse
from loomgraph.sources import tables

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 20_000
_QUERIES_AT_ONCE = 256


def scores(points: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, score): cosine of every stated query vector with every point.

    A set of queries that fits a broadcast is sent to the points, which stay where they are. A larger one is cut into blocks
    of that size by hash, and every point meets each block once.
    """
    q = queries.select(F.col(query).alias("query"), vectors.normalize(F.col(vector)).alias("qv"))
    p = points.select(F.col(doc).alias("doc"), vectors.normalize(F.col(vector)).alias("pv"))
    score = vectors.dot(F.col("qv"), F.col("pv")).alias("score")
    n = q.count()
    if n <= QUERY_BLOCK:
        return p.crossJoin(F.broadcast(q)).select("query", "doc", score)
    blocks = -(-n // QUERY_BLOCK)
    dealt = q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    met = p.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return met.join(dealt, "block").select("query", "doc", score)


def _best(k: int, asked, schema: StructType):
    """A function for mapInArrow over (doc, unit vector): of each batch the rows that can be among the k best of a query. asked()
    gives (query ids, matrix). Rows whose score is that of the k-th up to rounding stay too, since ties are decided later."""

    def run(batches):
        ids, matrix = asked()
        for batch in batches:
            keep = [i for i, v in enumerate(batch.column(1)) if v.is_valid and len(v) == matrix.shape[1] and v.values.null_count == 0]
            if not keep or not len(ids):
                continue
            docs = batch.column(0).take(pa.array(keep))
            points = np.array([batch.column(1)[i].values.to_numpy() for i in keep])
            for a in range(0, len(ids), _QUERIES_AT_ONCE):
                score = matrix[a : a + _QUERIES_AT_ONCE] @ points.T
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(score), -np.inf)
                q, d = np.nonzero(score >= least[:, None] - 4e-9)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + q)), docs.take(pa.array(d)), pa.array(score[q, d])], schema=to_arrow_schema(schema))

    return run


def search(points: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k nearest points of every query by cosine. Blocks of queries go to the points as a matrix, and only the best rows of each
    batch leave the task that read them. Points of another length than the queries', and null vectors, are found by none."""
    p = points.select(F.col(doc).alias("doc"), vectors.normalize(F.col(vector)).alias("pv"))
    q = queries.select(F.col(query).alias("query"), vectors.normalize(F.col(vector)).alias("qv")).where("qv is not null")
    schema = StructType([StructField("query", q.schema["query"].dataType), StructField("doc", p.schema["doc"].dataType), StructField("score", DoubleType())])
    kind = to_arrow_type(q.schema["query"].dataType)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    dealt = tables.cut(q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "asked") if blocks > 1 else q
    found = []
    for block in range(blocks):
        rows = (dealt.where(F.col("block") == block) if blocks > 1 else dealt).select("query", "qv").collect()  # a block at most
        same = max((len(r["qv"]) for r in rows), default=0)
        rows = [r for r in rows if len(r["qv"]) == same and None not in r["qv"]]
        sent = points.sparkSession.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["qv"] for r in rows], dtype=np.float64).reshape(len(rows), same)))
        found.append(p.mapInArrow(_best(k, lambda sent=sent: (pa.array(sent.value[0], kind), sent.value[1]), schema), schema))
    return bm25.top(reduce(DataFrame.unionByName, found), k)


def max_pool(weights: DataFrame, special: int = 3) -> DataFrame:
    """(doc, token, weight): of each token id above the special ones the largest weight in the document."""
    return weights.where(F.col("token") > special).groupBy("doc", "token").agg(F.max("weight").alias("weight"))


def sparse_search(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Dot products of sparse vectors, both as rows (doc or query, token, weight)."""
    listed = points.groupBy("doc").agg(F.collect_list(F.struct("token", "weight")).alias("p"))
    rows = listed.select("doc", F.col("p.token").alias("terms"), F.col("p.weight").cast("array<double>").alias("weights"))
    return bm25.top(sparse.candidates(rows, queries.select("query", F.col("token").alias("term"), "weight"), k), k)
