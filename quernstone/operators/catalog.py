"""Releases and document lookup, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import DEFAULT_BRANCH, FEATURE_MARK, NON_RELEASE
from quernstone.functions.text import docs_url, repo_path, trim_ws
from quernstone.operators.markdown import parse_docs


#: Up to so many requests are broadcast; up to PATHS of them prune by path.
REQUESTS, PATHS = 200_000, 1000


def is_release(name: Column) -> Column:
    return ~name.isin(*NON_RELEASE) & ~name.contains(FEATURE_MARK)


def releases(refs: DataFrame) -> DataFrame:
    """(name, committed_at, commit, is_default) of the refs that are releases."""
    return refs.where(is_release(F.col("name")))


def default_branch(refs: DataFrame) -> DataFrame:
    """At most one name: the default branch, unless it is never a release."""
    return refs.where(F.col("is_default") & ~F.col("name").isin(*NON_RELEASE)).select("name").limit(1)


def latest_release(refs: DataFrame) -> DataFrame:
    """One row (release): the default branch, else the newest release, else the fallback."""
    newest = releases(refs).orderBy(F.desc("committed_at"), "name").select("name").limit(1)
    ways = default_branch(refs).withColumn("way", F.lit(0)).unionByName(newest.withColumn("way", F.lit(1)))
    ways = ways.unionByName(refs.sparkSession.range(1).select(F.lit(DEFAULT_BRANCH).alias("name"), F.lit(2).alias("way")))
    return ways.agg(F.min_by("name", "way").alias("release"))


def versions(refs: DataFrame) -> DataFrame:
    """(ord, release, is_latest): the latest first, the rest newest first. Releases are few, whatever the corpus."""
    known = releases(refs)
    newest = known.orderBy(F.desc("committed_at"), "name").select("name").limit(1)
    top = default_branch(refs).withColumn("way", F.lit(0)).unionByName(newest.withColumn("way", F.lit(1))).agg(F.min_by("name", "way").alias("top"))
    rows = known.crossJoin(top).withColumn("is_latest", F.coalesce(F.col("name") == F.col("top"), F.lit(False)))
    nth = F.row_number().over(Window.orderBy(F.desc("is_latest"), F.desc("committed_at"), "name"))
    return rows.select(nth.cast("long").alias("ord"), F.col("name").alias("release"), "is_latest")


def resolve(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """``requests`` (source, version) with repo_path and release: known version, else the path's release, else the latest."""
    known = releases(refs).agg(F.array_sort(F.collect_set("name")).alias("_known"))  # release names are few
    rows = requests.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(latest_release(refs).withColumnRenamed("release", "_latest")))
    rows = rows.withColumn("_path", repo_path(F.col("source"), F.col("_known")))
    asked = F.when(F.array_contains("_known", F.lower("version")), F.lower("version"))
    release = F.coalesce(asked, F.col("_path.release_in_path"), F.col("_latest"))
    return rows.withColumn("repo_path", F.col("_path.repo_path")).withColumn("release", release).drop("_known", "_latest", "_path")


def write_library(docs: DataFrame, at: str) -> None:
    """``docs`` (release, path, content) as a table that lookups prune: a folder for each release, bloom filters on path."""
    docs.repartition("release", F.pmod(F.xxhash64("path"), F.lit(docs.sparkSession.sparkContext.defaultParallelism))).sortWithinPartitions("release", "path").write.mode("overwrite").option("parquet.bloom.filter.enabled#path", "true").partitionBy("release").parquet(at)


def fetch_many(requests: DataFrame, refs: DataFrame, docs: DataFrame, docs_base: str) -> DataFrame:
    """``requests`` (request_id, source, version) with found, markdown, source_url, path, release; a miss has found false.

    ``docs`` (release, path, content), best partitioned by release, meets the requests where
    it is read: up to REQUESTS of them are broadcast, and up to PATHS prune files and row groups by
    their paths, so contents aren't shuffled. Misses come from the requests' side alone.
    """
    asked = resolve(requests, refs)
    asked = asked.select("request_id", "repo_path", "release", F.when(F.col("repo_path") != "", F.regexp_replace("repo_path", "^markdown/", "")).alias("_clean"))
    # Blank documents count as missing.
    there = docs.select(F.col("release").alias("_release"), F.col("path").alias("_p"), "content").where(trim_ws(F.col("content")) != "")
    few = requests.limit(REQUESTS + 1).count()
    if few <= PATHS:
        rows = asked.collect()
        asked = requests.sparkSession.createDataFrame(rows, asked.schema)
        there = there.where(F.col("_p").isin([r["_clean"] for r in rows if r["_clean"]]) & F.col("_release").isin(sorted({r["release"] for r in rows})))
    near = F.broadcast if few <= REQUESTS else (lambda table: table)
    same = (F.col("release") == F.col("_release")) & (F.col("_clean") == F.col("_p"))
    found = parse_docs(there.join(near(asked), same))
    body = trim_ws(F.col("body"))
    markdown = F.when((F.col("meta.title") != "") & ~body.startswith("#"), F.concat(F.lit("# "), F.col("meta.title"), F.lit("\n\n"), body)).otherwise(body)
    url = F.when(F.col("meta.canonical_url") == "", docs_url(F.col("repo_path"), docs_base)).otherwise(F.col("meta.canonical_url"))
    hits = found.select("request_id", F.lit(True).alias("found"), markdown.alias("markdown"), url.alias("source_url"), F.col("repo_path").alias("path"), "release")
    known = there.join(near(asked), same).select("request_id").distinct()
    none = F.lit(None).cast("string")
    misses = asked.join(known, "request_id", "left_anti").select("request_id", F.lit(False).alias("found"), none.alias("markdown"), none.alias("source_url"), F.col("repo_path").alias("path"), "release")
    return hits.unionByName(misses)
