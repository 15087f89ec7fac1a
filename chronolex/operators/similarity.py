"""Cosine similarity of query vectors against all vectors, block by block.

Vectors are packed into blocks within their partitions; every block of queries meets every
block of rows, and a pair of blocks is one matrix product. Nothing but blocks is held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block.
BLOCK = 256


def _blocks(df: DataFrame, prefix: str) -> DataFrame:
    """``ids, vectors`` with the prefix: the ids of up to BLOCK vectors, and the vectors end to end."""
    names = [prefix + "ids", prefix + "vectors"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = np.array(part.column(1).to_pylist(), dtype=np.float64)  # fails if lengths differ
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.ravel()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(pack, f"{names[0]} array<long>, {names[1]} array<double>")


def similar_vectors(rows: DataFrame, queries: DataFrame, min_similarity: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id_col, similarity``: all rows at least so similar to each query, itself included.

    Null vectors and those of length zero are similar to nothing.
    """
    chosen = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    q, r = (_blocks(df.select(*chosen).filter("v is not null"), p) for df, p in ((queries, "q"), (rows, "r")))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1)
                qi, ri = (np.array(pair.column(c)[0].values) for c in ("qids", "rids"))
                qm, rm = (np.array(pair.column(c)[0].values).reshape(len(i), -1) for c, i in (("qvectors", qi), ("rvectors", ri)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = qm @ rm.T / np.sqrt(np.outer((qm * qm).sum(1), (rm * rm).sum(1)))
                    a, b = np.nonzero(s >= min_similarity)
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[b]), pa.array(s[a, b])], names=["query_id", id_col, "similarity"])

    return q.crossJoin(r).mapInArrow(match, f"query_id long, {id_col} long, similarity double")
