"""Extension: chunks and indexes kept up to date from streams.

The library's data model has no streams; freshness is polling. Where documents arrive as
files, this chunks each micro-batch and keeps the newest version of each document's chunks;
where they stand in a branch of a git repository, an index in segments follows its commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.markdown import chunk_docs
from quernstone.plans import segments
from quernstone.sources import git

SCHEMA = "release string, path string, content string, commit string"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of documents as they arrive."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def keep_chunks(docs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks of each batch to ``table``, with the batch's number; a batch that runs again replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        chunks = chunk_docs(batch).withColumn("batch", F.lit(number))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(chunks: DataFrame) -> DataFrame:
    """The chunks of each document's last batch."""
    last = F.max("batch").over(Window.partitionBy("release", "path"))
    return chunks.withColumn("_last", last).where("batch = _last").drop("_last")


def follow_branch(spark: SparkSession, folder: str, branch: str, index: str, checkpoint: str) -> StreamingQuery:
    """Takes what changed in ``branch`` since the checkpoint's commit into the segmented index at ``index``: a segment for each batch.

    A batch that broke off is taken again between the same two commits and replaces its segment.
    """
    segments.create(spark, index)

    def add(batch: DataFrame, number: int) -> None:
        segments.add(batch.sparkSession, index, number, batch)

    return git.changes(spark, folder, branch).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
