"""The jobs: two runs over growing input, reruns, and their SQL."""

import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import answers, queries, reindex
from jobs.common import config_of

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(got[columns].values.tolist(), key=repr) == sorted(want[columns].values.tolist(), key=repr)
    assert before == {k: spark.conf.get(k, None) for k in before}


def live(spark, at) -> dict:
    return {r["path"]: r["content"] for r in reindex.read(spark, at).collect()}


def test_reindex_takes_what_is_new(spark, tmp_path, caplog):
    source, at, point = (str(tmp_path / x) for x in ("in", "index", "point"))
    config = config_of("reindex", buckets=2, parts=2)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put([(1, "one", "en", "a"), (2, "two", "en", "a"), (3, None, "en", "a"), (None, "no path", "en", "a")])
    with caplog.at_level(logging.INFO, "quernstone.jobs"):
        assert reindex.run(spark, source, at, point, config)["batches"] == 1
    assert "wrote 2 chunks" in caplog.text and "in 1 batches" in caplog.text
    assert live(spark, at) == {"a/1.md": "one", "a/2.md": "two"}
    assert reindex.run(spark, source, at, point, config)["batches"] == 0
    assert live(spark, at) == {"a/1.md": "one", "a/2.md": "two"}
    # Input grows: one document changes, one goes, one comes.
    put([(1, "one more", "en", "a"), (2, None, "en", "a"), (4, "four", "de", "b")])
    assert reindex.run(spark, source, at, point, config)["batches"] == 1
    assert live(spark, at) == {"a/1.md": "one more", "b/4.md": "four"}
    sizes = {r["segment"]: (r["chunks"], r["dead_chunks"]) for r in spark.read.parquet(f"{at}/sizes").collect()}
    assert sizes == {0: (2, 0), 1: (2, 2)}
    # Files that come one by one are batches of their own.
    put([(5, "five", "en", "a")])
    put([(5, "five again", "en", "a"), (5, "not this", "en", "a")])
    assert reindex.run(spark, source, at, point, config | {"files_a_batch": 1})["batches"] == 2
    assert set(live(spark, at)) == {"a/1.md", "b/4.md", "a/5.md"}


def test_reindex_repeats_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    source, at, point = (str(tmp_path / x) for x in ("in", "index", "point"))
    config = config_of("reindex", buckets=2, parts=2)
    spark.createDataFrame([(1, "one", "en", "a"), (2, "two", "en", "a")], SCHEMA).write.parquet(source)
    whole = reindex.segments.add

    def broken(*args):
        whole(*args)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(reindex.segments, "add", broken)
    with pytest.raises(Exception, match="the driver is lost"):
        reindex.run(spark, source, at, point, config)
    monkeypatch.setattr(reindex.segments, "add", whole)
    reindex.run(spark, source, at, point, config)
    assert live(spark, at) == {"a/1.md": "one", "a/2.md": "two"} and reindex.segments.visible(spark, at) == [0]


def test_answers_replace_the_last_ones(spark, tmp_path):
    names = ("documents", "embeddings", "benchmark")
    paths = [f"{FOLDER}/{n}.parquet" for n in names]
    at, config = str(tmp_path / "out"), config_of("answers", limit=3)
    plain = lambda: sorted(map(tuple, answers.read(spark, at).collect()), key=repr)
    counts = answers.run(spark, *paths, at, config)
    first = plain()
    assert counts["answers"] == len(first) == 3 * counts["questions"] and {r[-1] for r in first} <= {"en", "de", "fr", "es"}
    assert answers.run(spark, *paths, at, config) == counts and plain() == first
    # Fewer questions leave nothing old behind; null, blank and odd rows have defined answers.
    rows = [(0, "zzzz"), (1, " "), (2, None), (None, "the"), (10**9, "the of and")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "q"))
    answers.run(spark, *paths[:2], str(tmp_path / "q"), at, config)
    assert {r[0] for r in plain()} <= {0, 10**9} and 0 in {r[0] for r in plain()}
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "item_id long, text string").write.parquet(empty)
    assert answers.run(spark, *paths[:2], empty, at, config)["answers"] == 0


def test_command_lines(tmp_path):
    """Both jobs as they are run from a shell, with a configuration file; the incremental one twice."""
    c = duckdb.connect()
    for t, columns, n in (("documents", "*", 40), ("embeddings", "*", 40), ("benchmark", "*", 3)):
        (tmp_path / t).mkdir()
        c.sql(f"copy (select {columns} from '{FOLDER}/{t}.parquet' limit {n}) to '{tmp_path}/{t}/a.parquet'")
    (tmp_path / "c.json").write_text('{"limit": 2}')
    (tmp_path / "r.json").write_text('{"buckets": 2, "parts": 2}')
    at = lambda name: str(tmp_path / name)
    runs = {
        "answers": ["--documents", at("documents"), "--vectors", at("embeddings"), "--questions", at("benchmark"), "--output", at("answers"), "--config", at("c.json")],
        "reindex": ["--documents", at("documents"), "--output", at("index"), "--checkpoint", at("point"), "--config", at("r.json")],
    }
    for job, given in runs.items():
        for n in range(2 if job == "reindex" else 1):
            done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *given], capture_output=True, text=True, cwd=Path(__file__).parent.parent, env={**os.environ, "SPARK_CONF_DIR": ""}, timeout=300)
            assert done.returncode == 0, done.stderr[-2000:]
            assert ("wrote 6 answers" if job == "answers" else f"in {1 - n} batches") in done.stderr
    assert c.execute(f"select count(*), count(distinct query_id) from '{tmp_path}/answers/*/*.parquet'").fetchone() == (6, 3)


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"limit": 2}')
    assert config_of("answers", str(tmp_path / "c.json"))["limit"] == 2
    with pytest.raises(ValueError):
        config_of("answers", limits=3)
    for job in ("answers", "reindex"):
        shown = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], capture_output=True, text=True, cwd=Path(__file__).parent.parent, check=True)
        assert "--config" in shown.stdout
