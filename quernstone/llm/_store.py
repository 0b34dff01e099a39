"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.shared import session_folder

def new_folder(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def blocks(docs: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """(block_id, n_bytes, path): rows of ``docs`` in compressed files of about ``block_bytes`` of text, all columns kept.

    The files stand in the shared folder and the table that names them is written there, so
    a block's number and content never change afterwards, also if executors are lost; what
    a lost task left behind is named nowhere. Exchanges move a block's path, never its text.
    """
    folder = new_folder(docs.sparkSession, f"{name}-files")

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)

        def row():
            block_id = (part << 32) + seq
            path = f"{base}/{block_id}-{uuid.uuid4().hex}"
            with store.open_output_stream(path) as out:
                out.write(pack(pa.Table.from_batches(held).combine_chunks()))
            return pa.RecordBatch.from_pydict({"block_id": pa.array([block_id], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "path": pa.array([path])})

        for batch in batches:
            from quernstone.llm._bytes import column_bytes, slices

            at = column_bytes(batch.column("text"))[1]
            for i, j in slices(at, max(1, block_bytes // 4)):
                held.append(batch.slice(i, j - i))
                size += int(at[j] - at[i])
                if size >= block_bytes:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    table = written(docs.mapInArrow(run, "block_id long, n_bytes long, path string"), name)
    return table.withColumn("folder", F.lit(folder))


def filesystem(folder: str):
    """The file system of a shared folder's URI and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def read_block(folder: str, path: str) -> pa.Table:
    with filesystem(folder)[0].open_input_stream(path) as data:
        return unpack(data.read())


def dealt(table: DataFrame, key: str, n: int, each: int) -> DataFrame:
    """``table`` hash-partitioned by ``key``, about ``each`` of its ``n`` values together: the number of tasks follows the input, whatever the rows' size."""
    return table.repartition(max(1, -(-n // each)), key)


def bucket_count(table: DataFrame, bucket_bytes: int) -> int:
    """How many buckets keep one bucket's share of the text near ``bucket_bytes``."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // bucket_bytes))
