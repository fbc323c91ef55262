"""Model calls as plain functions over Columns or pandas batches, with deterministic offline defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import text, vectors


def hashed_embedder(body: Column) -> Column:
    return vectors.hashed_embedding(text.tokens(body))


def lexical_reranker(query: Column, doc: Column) -> Column:
    """The share of the query's distinct terms that the document has."""
    q, d = F.array_distinct(text.tokens(query)), F.array_distinct(text.tokens(doc))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def equal_names(a: Column, b: Column) -> Column:
    """Confirms a merge of names that differ only in case and punctuation."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return bare(a) == bare(b)


@dataclass(frozen=True)
class Hooks:
    """Embedder: text -> vector. Reranker: (query, document) -> score from 0 to 1. Merger: (name, name) -> boolean. Any of them may
    be a pandas UDF."""

    embed: Callable[[Column], Column] = hashed_embedder
    rerank: Callable[[Column, Column], Column] = lexical_reranker
    confirm_merge: Callable[[Column, Column], Column] = equal_names
