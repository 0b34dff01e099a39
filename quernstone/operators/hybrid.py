"""Reciprocal rank fusion of lexical and vector search, best chunk for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import DEFAULT_LIMIT, POOL_FACTOR, POOL_LEAST, RRF_K
from quernstone.functions.text import first_filled, hit_url, snippet, trim_ws
from quernstone.operators.lexical import LITERAL_TERMS, LexicalIndex, bm25, top
from quernstone.operators.vector import knn, nearest

HIT = ("path", "title", "breadcrumb", "anchor", "release", "url", "snippet", "score")


#: Up to so many rows of ids and scores are broadcast.
FEW = 200_000


def pool_size(limit: int) -> int:
    return max(POOL_FACTOR * max(limit, 0), POOL_LEAST)


def fuse(lexical: DataFrame, vector: DataFrame, one: bool = False) -> DataFrame:
    """(query_id, id, score, position) of two arms (query_id, id, rank): summed reciprocal ranks; position orders ties.

    Ties keep the order in which the arms name the ids: all of the lexical arm by rank,
    then those of the vector arm alone. one: both arms are of one query, two pools of rows in all.
    """
    share = lambda: F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("rank") + F.lit(1.0))
    both = lexical.select("query_id", "id", share().alias("s"), F.col("rank").alias("lex"), F.lit(None).cast("int").alias("vec"))
    both = both.unionByName(vector.select("query_id", "id", share().alias("s"), F.lit(None).cast("int").alias("lex"), F.col("rank").alias("vec")))
    both = both.coalesce(1) if one else both
    each = both.groupBy("query_id", "id").agg(F.sum("s").alias("score"), F.max("lex").alias("lex"), F.max("vec").alias("vec"))
    counted = F.count("lex").over(Window.partitionBy("query_id"))  # at most two pools of rows for each query
    return each.select("query_id", "id", "score", F.coalesce("lex", counted + F.col("vec")).alias("position"))


def winners(fused: DataFrame, chunks: DataFrame, limit: int, few: bool = False) -> DataFrame:
    """(query_id, id, path, score, position, rank): each path's best chunk, the first max(limit, 1) of each query; ids meet paths alone."""
    order = (F.desc("score"), F.asc("position"))
    rows = chunks.select("id", "path").join(F.broadcast(fused) if few else fused, "id")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))).where("_nth = 1").drop("_nth")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= max(limit, 1))


def best_of_paths(fused: DataFrame, chunks: DataFrame, limit: int, queries: int | None = None) -> DataFrame:
    """``fused`` joined to ``chunks``: each path's best chunk, the first max(limit, 1) of each query by rank (from 1).

    queries: how many queries there are at most. It bounds both joins: up to FEW rows of
    ``fused`` meet (id, path) by broadcast, and what is left of them meets titles and contents so;
    up to LITERAL_TERMS winners are looked up by their ids, which prunes row groups.
    """
    pooled = None if queries is None else queries * 2 * pool_size(limit)
    won = winners(fused, chunks, limit, pooled is not None and pooled <= FEW)
    if queries is not None and queries * max(limit, 1) <= LITERAL_TERMS:
        rows = won.collect()
        won = chunks.sparkSession.createDataFrame(rows, won.schema)
        chunks = chunks.where(F.col("id").isin([r["id"] for r in rows]))
    small = queries is not None and queries * max(limit, 1) <= FEW
    return chunks.join((F.broadcast(won) if small else won).drop("path"), "id")


def hits(rows: DataFrame, docs_base: str) -> DataFrame:
    """``rows`` of best_of_paths() as query_id, rank and HIT columns."""
    url = hit_url(F.col("path"), F.col("anchor"), F.col("canonical_url"), docs_base)
    title = first_filled(F.col("title"), F.col("heading"), F.col("path"))
    return rows.select("query_id", "rank", "path", title.alias("title"), "breadcrumb", "anchor", "release", url.alias("url"), snippet(F.col("content")).alias("snippet"), "score")


def search_batch(index: LexicalIndex, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, limit: int = DEFAULT_LIMIT, docs_base: str = "https://docs.example.org") -> DataFrame:
    """Hits of each of ``queries`` (query_id, query) with ``query_vectors`` (query_id, embedding); blank queries have none."""
    counted = queries.limit(FEW + 1).count()
    if counted == 1:
        return search_one(index, chunks, vectors, queries, query_vectors, limit, docs_base)
    lexical, vector = arms(index, vectors, queries, query_vectors, pool_size(limit))
    return hits(best_of_paths(fuse(lexical, vector), chunks, limit, counted if counted <= FEW else None), docs_base)


def search_one(index: LexicalIndex, chunks: DataFrame, vectors: DataFrame, query: DataFrame, query_vector: DataFrame, limit: int, docs_base: str) -> DataFrame:
    """search_batch() of one query: each arm is one ordered take, and what follows stays in one task, without a shuffle."""
    pool = pool_size(limit)
    asked = query.where(trim_ws(F.col("query")) != "")
    found = query_vector.join(F.broadcast(asked.select("query_id")), "query_id").select("query_id", F.col("embedding").cast("array<double>").alias("q")).limit(1).collect()
    lexical = bm25(index, asked, pool, one=True)
    none = lexical.select("query_id", "id", "rank").limit(0)
    vector = none
    if found:
        near = nearest(vectors, list(found[0]["q"]), pool).select(F.lit(found[0]["query_id"]).alias("query_id"), "id", "distance")
        vector = top(near, pool, F.col("distance"), one=True)
    fused = fuse(lexical, vector, one=True)
    return hits(best_of_paths(fused, chunks, limit, 1), docs_base)


def arms(index: LexicalIndex, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The lexical and the vector arm of ``queries``: none for blank ones, the vector arm alone for those without terms."""
    asked = queries.where(trim_ws(F.col("query")) != "")
    return bm25(index, asked, pool), knn(vectors, query_vectors.join(asked.select("query_id"), "query_id", "left_semi"), pool)
