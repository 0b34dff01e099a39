"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.vectors import l2_distance
from quernstone.operators.lexical import top
from quernstone.shared import store

#: Query vectors and vectors that a worker holds at a time.
QUERIES, VECTORS = 2048, 16384


def knn(vectors: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, distance, rank): the ``pool`` nearest of (id, embedding) for each of (query_id, embedding), ties by id.

    Queries are written to the shared folder. Each worker takes its vectors in blocks of
    bounded size and reads the queries block by block, so vectors are scanned once and no
    process holds all queries. Two blocks are compared by one matrix product; what may be
    among the nearest is then computed exactly.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    folder = store(asked, "query-vectors")
    base = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")

    def run(batches):
        from pyarrow import dataset, fs

        files, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        held: list[pa.RecordBatch] = []

        def compared():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
            for block in dataset.dataset(path, filesystem=files, format="parquet").to_batches(batch_size=QUERIES):
                if block.num_rows:
                    yield _nearest_of(block.column("query_id").to_numpy(), matrix(block.column("q")), ids, x, pool)

        for batch in batches:
            for a in range(0, batch.num_rows, VECTORS):
                held.append(batch.slice(a, VECTORS))
                if sum(b.num_rows for b in held) >= VECTORS:
                    yield from compared()
                    held = []
        if held:
            yield from compared()

    return top(base.mapInArrow(run, "query_id long, id long, distance double"), pool, F.col("distance"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pool: int) -> pa.RecordBatch:
    if q.shape[1] != x.shape[1]:
        raise ValueError(f"a vector has {x.shape[1]} components and a query {q.shape[1]}")
    rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    k = min(pool, len(ids))
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (1 + np.abs(rough).max())
    i, j = np.nonzero(rough <= edge[:, None])
    exact = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
    return pa.RecordBatch.from_pydict({"query_id": q_ids[i], "id": ids[j], "distance": exact})


def nearest(vectors: DataFrame, query: list[float], pool: int) -> DataFrame:
    """(id, distance) for one query vector: a native scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", l2_distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "id").limit(pool)
