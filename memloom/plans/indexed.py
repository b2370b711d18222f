"""Retrieval from stored indexes: the same results as the scans, from partitions and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.shared import scratch
from memloom.operators.text_index import TextIndex
from memloom.operators.vector_index import VectorIndex
from memloom.plans.registry import query
from memloom.plans.retrieval import LEX, VEC
from memloom.plans.views import TERMS, Tables


def vectors(t: Tables) -> VectorIndex:
    return VectorIndex.build(t.vectors().select("id", "embedding"), scratch(t.spark, "vectors"))


@query("SELECT id, distance FROM dist ORDER BY distance, id LIMIT 10", *VEC)
def ret_vector_index(t: Tables) -> DataFrame:
    """The nearest rows by an exact search of the stored cells."""
    return vectors(t).search(t.query_vector(), 10)


_COSINE = "round(1e0 - list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


@query(f"SELECT q.vec_id AS query_id, d.id, {_COSINE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE}, d.id) AS rank FROM embeddings q, mem d WHERE q.vec_id % 100 = 0 AND d.embedding IS NOT NULL QUALIFY rank <= 10", "mem")
def ret_vector_index_many(t: Tables) -> DataFrame:
    """The ten nearest rows of every hundredth vector, searched together in the stored cells."""
    asked = t.base("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors(t).search_many(asked, 10)


@query("SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 10", *LEX)
def ret_bm25_index(t: Tables) -> DataFrame:
    """The best rows for three terms from stored postings."""
    return TextIndex.build(t.mem().select("id", "content"), scratch(t.spark, "postings")).search(TERMS, 10)
