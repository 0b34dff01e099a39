"""Exact nearest neighbours by Euclidean distance, with blocks left out by distances to pivots.

Pivots are a few of the vectors. Each vector lies in the cell of its nearest pivot, at a stored
distance; a cell's vectors in order of that distance fall into blocks of about BLOCK, of which
the least and the greatest distance are kept. By the triangle inequality no vector of a block is
nearer to a query than the query's distance to the pivot lies outside that range. Blocks of the nearest
pivots are compared first, with FIRST times the pool's rows; those whose bound is above the pool's last distance then can't hold a
neighbour. Where distances tell little, as in many dimensions without clusters, nearly all blocks are compared,
and the result is exact all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.vectors import l2_distance
from quernstone.operators.lexical import top
from quernstone.shared import written

PIVOTS, BLOCK, FIRST = 64, 64, 4
#: Pairs of a query and a block, and queries with their vectors, of up to so many are broadcast.
PAIRS, QUERIES = 1_000_000, 20_000
#: Distances are sums of rounded squares; bounds give way by this part of the distances they come from.
SLACK = 1e-9


@dataclass
class PivotIndex:
    """pivots (cell, p), vectors (cell, block, id, embedding) and blocks (cell, block, n, lo, hi)."""

    pivots: DataFrame
    vectors: DataFrame
    blocks: DataFrame


def write_pivots(vectors: DataFrame, at: str, pivots: int = PIVOTS, block: int = BLOCK) -> None:
    """The index of (id, embedding) below the folder ``at``; rows without vector are left out. ``pivots`` rows, those of the least hash, are the pivots.

    A cell's vectors are ranked by distance within ranges, so a cell with most rows is in as many tasks as it fills.
    """
    spark = vectors.sparkSession
    fine = vectors.select("id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    chosen = fine.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    rows = [(i, list(r["v"])) for i, r in enumerate(chosen)]
    spark.createDataFrame(rows, "cell int, p array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/pivots")
    # ``pivots`` vectors at most.
    literal = F.array(*[F.array(*[F.lit(x) for x in p]) for _, p in rows]) if rows else F.array(F.array(F.lit(0.0)))
    other = F.raise_error(F.lit("vectors differ in length")).cast("double")
    far = F.transform(literal, lambda p: l2_distance(F.col("v"), p))
    near = fine.withColumn("far", far).withColumn("d", F.coalesce(F.array_min("far"), other)).withColumn("cell", F.array_position("far", F.col("d")).cast("int") - 1)
    near = written(near.select("cell", "d", "id", "v"), "pivot-distances")
    many = near.count()
    n = max(1, -(-many // (1024 * block)))
    # Written, since ranges drawn anew could differ.
    ranged = written(near.repartitionByRange(n, "cell", "d", "id").withColumn("part", F.spark_partition_id()), "pivot-ranges")
    nth = F.row_number().over(Window.partitionBy("part", "cell").orderBy("d", "id")) - 1
    blocked = ranged.withColumn("block", (F.col("part").cast("long") * F.lit(1 << 32)) + F.floor(nth / block))
    blocked.select("cell", "block", "d", "id", F.col("v").alias("embedding")).write.mode("overwrite").partitionBy("cell").parquet(f"{at}/vectors")
    stored = spark.read.schema(VECTORS).parquet(f"{at}/vectors")
    stored.groupBy("cell", "block").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).write.mode("overwrite").parquet(f"{at}/blocks")


VECTORS = "block long, d double, id long, embedding array<double>, cell int"


def open_pivots(spark: SparkSession, at: str) -> PivotIndex:
    vectors = spark.read.schema(VECTORS).parquet(f"{at}/vectors").select("cell", "block", "id", "embedding")
    return PivotIndex(spark.read.parquet(f"{at}/pivots"), vectors, spark.read.parquet(f"{at}/blocks"))


@dataclass
class PivotSearch:
    """hits: (query_id, id, distance, rank); blocks: (query_id, cell, block, n, bound, first, read) of all blocks."""

    hits: DataFrame
    blocks: DataFrame


def knn(index: PivotIndex, queries: DataFrame, pool: int) -> PivotSearch:
    """The ``pool`` nearest for each of (query_id, embedding), ties by id: the rows of ``vector.knn``."""
    asked = written(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null"), "query-vectors")
    # A row for each query and pivot, then for each query and block: blocks are one in BLOCK of the rows.
    other = F.raise_error(F.lit("a query's length differs from the vectors'")).cast("double")
    to_pivots = asked.crossJoin(F.broadcast(index.pivots)).select("query_id", "cell", F.coalesce(l2_distance(F.col("q"), F.col("p")), other).alias("away"))
    bounds = to_pivots.join(F.broadcast(index.blocks) if index.blocks.count() <= PAIRS else index.blocks, "cell")
    out = F.greatest(F.col("away") - F.col("hi"), F.col("lo") - F.col("away"), F.lit(0.0)) - SLACK * (1 + F.col("away") + F.col("hi"))
    bounds = bounds.select("query_id", "cell", "block", "n", "away", out.alias("bound"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("away", "bound", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = written(bounds.withColumn("first", before < FIRST * pool).drop("away"), "pivot-bounds")

    def compared(pairs: DataFrame) -> DataFrame:
        many = pairs.count()
        near = F.broadcast if many <= PAIRS else (lambda table: table)
        wide = F.broadcast if asked.count() <= QUERIES else (lambda table: table)
        met = index.vectors.join(near(pairs.select("query_id", "cell", "block")), ["cell", "block"]).join(wide(asked), "query_id")
        return met.select("query_id", "id", l2_distance(F.col("embedding"), F.col("q")).alias("distance"))

    first = written(top(compared(bounds.where("first")), pool, F.col("distance")), "first-neighbours")
    # One row for each query; fewer rows than ``pool`` set no limit.
    last = first.groupBy("query_id").agg(F.count("*").alias("k"), F.max("distance").alias("last")).where(F.col("k") >= pool).select("query_id", "last")
    blocks = bounds.join(last, "query_id", "left").withColumn("read", F.col("first") | F.col("last").isNull() | (F.col("bound") <= F.col("last")))
    rest = compared(blocks.where("read and not first"))
    hits = top(first.select("query_id", "id", "distance").unionByName(rest), pool, F.col("distance"))
    return PivotSearch(hits, blocks.drop("last"))
