"""The best documents for each question of a list, by words and by vectors.

    python -m jobs.answers --documents DIR --vectors DIR --questions DIR --output DIR [--config FILE]

For those who answer many questions from one collection of documents, as a support desk or a
test of search quality does each night. Documents are indexed, each question is searched by BM25
and by its vector (the one of its own id), both lists are fused, and each document's best hit is
kept. The answers lie in Parquet, in a folder for each partition; each run replaces all of them, so
that a run again has the same result and a run after a change leaves nothing old behind.

Settings (``jobs/answers.json``): ``document``, ``vector`` and ``question`` are SQL expressions over the
tables' columns, ``partition`` one over the answers' columns; ``limit`` hits a question. Rows
without id or question are left out; a question without words is searched by its vector
alone, one without a vector by its words, a blank one not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, config_of, log, session
from quernstone.operators import hybrid, lexical
from quernstone.shared import written

#: Answers of a file, at most about.
FILE_ROWS = 500_000
ANSWERS = "query_id long, rank int, path string, title string, breadcrumb string, anchor string, release string, url string, snippet string, score double, part string"


def chunks_of(documents: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """The documents as chunks, one each."""
    named = {k: F.coalesce(F.expr(exprs[k]).cast("string"), F.lit("")) for k in ("path", "title", "breadcrumb", "release", "content")}
    empty = {k: F.lit("") for k in ("anchor", "heading", "canonical_url", "last_updated")}
    return documents.select(F.expr(exprs["id"]).cast("long").alias("id"), *[v.alias(k) for k, v in (named | empty).items()]).where("id is not null")


def run(spark: SparkSession, documents: str, vectors: str, questions: str, output: str, config: dict) -> dict[str, int]:
    """Writes the answers below ``output``; what it read and wrote, as numbers of rows."""
    docs = chunks_of(spark.read.parquet(documents), config["document"])
    near = spark.read.parquet(vectors).selectExpr(f"cast({config['vector']['id']} as long) as id", f"{config['vector']['embedding']} as embedding").where("id is not null and embedding is not null")
    asked = spark.read.parquet(questions).selectExpr(f"cast({config['question']['query_id']} as long) as query_id", f"cast({config['question']['query']} as string) as query").where("query_id is not null and query is not null")
    asked = written(asked, "questions")
    counts = {"documents": docs.count(), "vectors": near.count(), "questions": asked.count()}
    log.info("read %(documents)d documents, %(vectors)d vectors, %(questions)d questions", counts)
    index = lexical.build(docs, config["stemmed"])
    of_questions = near.withColumnRenamed("id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    found = hybrid.search_batch(index, docs, near, asked, of_questions, config["limit"], config["docs_base"])
    found = found.withColumn("part", F.expr(config["partition"]).cast("string"))
    # A part that most answers have is in as many tasks and files as it may fill.
    salt = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-counts["questions"] * max(config["limit"], 1) // FILE_ROWS))))
    found.repartition("part", salt).sortWithinPartitions("part", "query_id", "rank").write.mode("overwrite").partitionBy("part").parquet(output)
    counts["answers"] = read(spark, output).count()
    log.info("wrote %d answers to %s", counts["answers"], output)
    return counts


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(output)


def main() -> None:
    given = arguments("The best documents for each question of a list.", "documents", "vectors", "questions", "output")
    spark = session("answers")
    try:
        run(spark, given.documents, given.vectors, given.questions, given.output, config_of("answers", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
