"""A search index kept up to date from files of documents as they arrive.

    python -m jobs.reindex --documents DIR --output DIR --checkpoint DIR [--config FILE]

A file stream takes the files that its checkpoint doesn't name yet, in batches, and stops when
there are no more; run it as often as the index shall be fresh. Each batch becomes a segment of the
index (``quernstone.plans.segments``): its documents are chunked and indexed, and what they
replace is marked as dead. Older segments aren't read but for the keys of changed documents. A batch
that broke off is taken again with the same files and number, and replaces its own segment.

Settings (``jobs/reindex.json``): ``release``, ``path``, ``content`` and ``order`` are SQL expressions over
the files' columns. A document is told by release and path; of one that comes twice the later batch
counts, within a batch the greater ``order``. Null content takes a document away; rows
without path are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, config_of, log, session
from quernstone.plans import segments


def pattern_of(path: str) -> str:
    """``path`` as a pattern that it alone matches: file streams take a single file by pattern only, folders either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def changes_of(rows: DataFrame, config: dict) -> DataFrame:
    named = rows.selectExpr(f"cast({config['release']} as string) as release", f"cast({config['path']} as string) as path", f"cast({config['content']} as string) as content", f"cast({config['order']} as long) as seq")
    return named.withColumn("release", F.coalesce("release", F.lit(""))).where("path is not null")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes the files below ``documents`` that are new to ``checkpoint`` into the index below ``output``; numbers of batches and rows read."""
    segments.create(spark, output, config["buckets"], config["parts"], config["stemmed"], config["embed_model"])
    arriving = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(pattern_of(documents))

    def take(batch: DataFrame, number: int) -> None:
        segments.add(batch.sparkSession, output, number, changes_of(batch, config))
        made = batch.sparkSession.read.schema(segments.SIZES).parquet(f"{output}/sizes").where(F.col("segment") == number).first()
        log.info("batch %d: wrote %d chunks of %d words to %s, %d chunks are dead", number, made["chunks"], made["words"], output, made["dead_chunks"])

    stream = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    batches = [p for p in stream.recentProgress if p["numInputRows"]]
    counts = {"batches": len(batches), "documents": sum(p["numInputRows"] for p in batches)}
    # A batch may read its rows more than once; Spark counts each time.
    log.info("read %d rows from %s in %d batches", counts["documents"], documents, counts["batches"])
    return counts


def read(spark: SparkSession, output: str) -> DataFrame:
    """The index's live chunks."""
    return segments.SegmentedIndex(spark, output).chunks


def main() -> None:
    given = arguments("A search index kept up to date from files of documents.", "documents", "output", "checkpoint")
    spark = session("reindex")
    try:
        run(spark, given.documents, given.output, given.checkpoint, config_of("reindex", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
