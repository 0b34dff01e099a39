"""Exact neighbours with blocks left out, against all distances."""

import numpy as np
import pytest

from quernstone.operators import pivots, vector


def rows_of(found):
    return [(r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("clusters", [0, 20])
def test_same_rows_as_all_distances(spark, tmp_path, clusters):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 8))
    if clusters:
        x = 10 * rng.normal(size=(clusters, 8))[rng.integers(0, clusters, 3000)] + 0.1 * x
        x[:1000] = x[0]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    vectors = spark.createDataFrame([*rows, (9999, None)], "id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([*rows[::150], (7777, None)], "query_id long, embedding array<float>")
    pivots.write_pivots(vectors, str(tmp_path / "index"), pivots=40, block=16)
    index = pivots.open_pivots(spark, str(tmp_path / "index"))
    for pool in (1, 12):
        found = pivots.knn(index, asked, pool)
        assert rows_of(found.hits) == rows_of(vector.knn(vectors, asked, pool))
        read, n = found.blocks.where("read").count(), found.blocks.count()
        assert found.blocks.where("read").selectExpr("sum(n)").first()[0] >= pool * 20
        # Ties of equal vectors must all be seen; clusters let the rest go.
        assert not clusters or read < 0.6 * n


def test_edges(spark, tmp_path):
    schema = "id long, embedding array<double>"
    few = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])]
    at = str(tmp_path / "few")
    pivots.write_pivots(spark.createDataFrame(few, schema), at)
    asked = spark.createDataFrame([(5, [0.0, 0.0])], "query_id long, embedding array<double>")
    found = pivots.knn(pivots.open_pivots(spark, at), asked, 10)
    assert rows_of(found.hits) == [(5, 0, 1, 0.0), (5, 1, 2, 5.0), (5, 2, 3, 5.0)]
    assert pivots.knn(pivots.open_pivots(spark, at), asked.where("false"), 10).hits.count() == 0
    with pytest.raises(Exception, match="length"):
        pivots.knn(pivots.open_pivots(spark, at), spark.createDataFrame([(5, [0.0])], asked.schema), 10)
    with pytest.raises(Exception, match="differ in length"):
        pivots.write_pivots(spark.createDataFrame([*few, (4, [1.0])], schema), str(tmp_path / "odd"), pivots=2)
    none = str(tmp_path / "none")
    pivots.write_pivots(spark.createDataFrame([], schema), none)
    assert pivots.knn(pivots.open_pivots(spark, none), asked, 3).hits.count() == 0
