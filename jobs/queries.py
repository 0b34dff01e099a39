"""The jobs as queries: each runs twice into one new folder of the shared store, and gives what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answers, reindex
from jobs.common import config_of
from quernstone.plans import registry
from quernstone.shared import shared_root


def new_folder(spark: SparkSession, name: str) -> str:
    """Its files stay."""
    return f"{shared_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item's text."""
    at = new_folder(spark, "answers")
    for _ in range(2):
        answers.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", f"{sf_dir}/benchmark.parquet", at, config_of("answers"))
    rows = answers.read(spark, at)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 9))


def job2_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents with frontmatter and headings; the second run finds nothing new."""
    at = new_folder(spark, "reindex")
    head = r"concat('---\ntitle: Doc ', doc_id, '\nbreadcrumb:\n  - ', source, '\n  - ', lang, '\ncanonical_url: \'https://docs.example.org/x\'\n---\n')"
    config = config_of("reindex", content=rf"concat({head}, replace(text, '\n', '\n\n## Part: A b!\n'))")
    for _ in range(2):
        reindex.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint", config)
    rows = reindex.read(spark, f"{at}/index")
    return rows.select("id", "path", "anchor", "title", "breadcrumb", "heading", "section", "window", F.md5("content").alias("content_md5"))


QUERIES = {"job1_answers": job1_answers, "job2_reindex": job2_reindex}
ORACLE_SQL = {
    "job1_answers": f"select *, coalesce(nullif(breadcrumb, ''), 'none') as part from ({registry.ORACLE_SQL['hybrid_search_batch']})",
    "job2_reindex": f"select id - 1 as id, path, anchor, title, breadcrumb, heading, cast(section as integer) as section, cast(w as integer) as window, md5(content) as content_md5 from ({registry._CHUNKS})",
}
