"""Stored layout, search by blocks, and an index in segments against one built from the last state."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quernstone.operators import catalog, hybrid, lexical, markdown
from quernstone.plans import registry, segments
from quernstone.sources import git
from quernstone.streaming import reindex

FOLDER = "/root/testdata/sf0.001"
DOCS = "release string, path string, content string"


def files_read(df) -> int:
    """How many files the scan of a plan without shuffles opens."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def built(spark):
    return lexical.stored(lexical.build(registry.chunks_of(spark, FOLDER), stemmed=False))


def test_a_search_opens_its_terms_buckets(spark, built):
    term = built.term_stats.orderBy(F.desc("df")).first()["term"]
    queries = spark.createDataFrame([(1, f"{term} zzzzzz")], "query_id long, query string")
    weighted = lexical.weights(built, queries)
    assert weighted.terms == [term]
    some = lexical.among(built.postings, weighted.terms, weighted.buckets)
    opened, all_ = files_read(some), len(built.postings.inputFiles())
    assert 1 <= opened <= max(1, all_ // 4) and some.count() == built.postings.where(F.col("term") == term).count()


def rows(df):
    return [(r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.orderBy("query_id", "rank").collect()]


def test_blocks_give_the_same_rows(spark, built):
    words = [r["term"] for r in built.term_stats.orderBy("df", "term").collect()]
    rng = random.Random(4)
    queries = [(i, " ".join(rng.choice(words[-300:]) for _ in range(1 + i % 4))) for i in range(30)] + [(90, ""), (91, "zzzzzz"), (92, " ".join(words[-1200:]))]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for pool in (1, 40):
        found = lexical.bm25_by_blocks(built, asked, pool)
        assert rows(found.hits) == rows(lexical.bm25(built, asked, pool))
    few = lexical.bm25_by_blocks(built, asked, 1).blocks
    read, of = few.where("read").count(), few.count()
    assert 0 < read < of
    with pytest.raises(ValueError):
        lexical.bm25_by_blocks(lexical.build(registry.chunks_of(spark, FOLDER), False), asked, 3)


def test_many_terms_give_the_same_rows(spark, built, monkeypatch):
    asked = registry.asked(spark, FOLDER)
    want = rows(lexical.bm25(built, asked, 10))
    for literal, broadcast in ((0, 200_000), (0, 1)):
        monkeypatch.setattr(lexical, "LITERAL_TERMS", literal)
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", broadcast)
        assert rows(lexical.bm25(built, asked, 10)) == want and rows(lexical.bm25_by_blocks(built, asked, 10).hits) == want


def test_counts_of_words(spark):
    made = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"] * 3,)], "w array<string>").select(lexical.counts(F.col("w")).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in made] == [[("a", 1), ("b", 2)], [], [("x", 3)]]


def test_stemmer_sees_distinct_terms(spark):
    words = lexical.said(registry.chunks_of(spark, FOLDER))
    known = lexical.stem_dictionary(words)
    assert known.count() == words.select("term").distinct().count() < words.count()
    plan = lexical.stemmed_counts(words)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df) -> list[str]:
    """The columns of each exchange of a plan."""
    found = []
    stack = [df._jdf.queryExecution().sparkPlan(), df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(node.output().mkString(","))
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_no_exchange_carries_content(spark, monkeypatch):
    # Tables are large: nothing is spread over the cores or broadcast for its size alone.
    monkeypatch.setattr(registry, "spread", lambda table: table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = registry.markdown_of(spark, FOLDER, False)
        made = [markdown.with_ids(markdown.chunk_docs(docs)), lexical.build(registry.chunks_of(spark, FOLDER), False).postings]
        for paths in (1000, 0):
            monkeypatch.setattr(catalog, "PATHS", paths)
            made.append(catalog.fetch_many(registry._requests(spark, FOLDER), registry.refs_of(spark, FOLDER), registry._library(spark, FOLDER), "https://d"))
        for few in (1000, 0):
            monkeypatch.setattr(hybrid, "LITERAL_TERMS", few)
            fused = hybrid.fuse(*registry._arms(spark, FOLDER))
            made.append(hybrid.best_of_paths(fused, registry.chunks_of(spark, FOLDER), 8, 40))
        won = hybrid.winners(fused, registry.chunks_of(spark, FOLDER), 8)
        for df in made:
            columns = exchanged(df)
            assert not any("content" in c or "text" in c or "_t#" in c for c in columns), columns
        assert any(exchanged(df) for df in made)
        assert "text#" not in ",".join(exchanged(won)) and "content#" not in plan_of(won)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_library_has_a_folder_for_each_release(spark, tmp_path):
    docs = spark.createDataFrame([("v1", "a.md", "x"), ("v2", "a.md", "y"), ("v2", "b.md", " ")], DOCS)
    catalog.write_library(docs, str(tmp_path / "lib"))
    stored = spark.read.schema("path string, content string, release string").parquet(str(tmp_path / "lib"))
    refs = spark.createDataFrame([("v1", 1, "c", False), ("v2", 2, "d", True)], "name string, committed_at long, commit string, is_default boolean")
    asked = spark.createDataFrame([(1, "a", "V1"), (2, "a.md", None), (3, "b", None), (4, "", None), (5, "c", "v1")], "request_id int, source string, version string")
    got = {r["request_id"]: (r["found"], r["markdown"], r["release"]) for r in catalog.fetch_many(asked, refs, stored, "https://d").collect()}
    assert got == {1: (True, "x", "v1"), 2: (True, "y", "v2"), 3: (False, None, "v2"), 4: (False, None, "v2"), 5: (False, None, "v1")}


def state(index: segments.SegmentedIndex) -> tuple:
    chunks = sorted((r["release"], r["path"], r["section"], r["window"], r["content"]) for r in index.chunks.collect())
    stats = sorted((r["term"], r["df"]) for r in index.lexical.term_stats.collect())
    return chunks, stats, [tuple(r) for r in index.lexical.corpus_stats.collect()]


def batches(seed: int) -> list[list[tuple]]:
    """Random changes: documents come, change, go, come back, repeat in a batch."""
    rng = random.Random(seed)
    words = ["flow", "flows", "table", "record", "é", "run", "running"]
    out = [[]]
    for _ in range(3):
        batch = []
        for _ in range(rng.randint(1, 8)):
            text = None if rng.random() < 0.3 else "\n".join(rng.choice(["# H ", "", "## T "]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(3))
            batch.append(("v1", f"p{rng.randint(0, 5)}.md", text, rng.choice([None, 1, 2])))
        out.append(batch)
    return out


def test_any_changes_equal_a_full_build(spark, tmp_path):
    at, last = str(tmp_path / "index"), {}
    segments.create(spark, at, buckets=3, parts=2)
    with pytest.raises(FileNotFoundError):
        segments.SegmentedIndex(spark, at)
    for k, batch in enumerate(batches(2)):
        segments.add(spark, at, k, spark.createDataFrame(batch, f"{DOCS}, seq int"))
        best = {}
        for release, path, text, seq in batch:
            rank = (seq is not None, seq or 0, text is not None, (text or "").encode())
            if path not in best or rank >= best[path][0]:
                best[path] = (rank, (release, path, text))
        last |= {p: row for p, (_, row) in best.items()}
    segments.add(spark, at, k, spark.createDataFrame(batch, f"{DOCS}, seq int"))  # as after a restart
    full = str(tmp_path / "full")
    segments.create(spark, full, buckets=3, parts=2)
    segments.add(spark, full, 0, spark.createDataFrame([r for r in last.values() if r[2] is not None], DOCS))
    want = state(segments.SegmentedIndex(spark, full))
    assert state(segments.SegmentedIndex(spark, at)) == want
    segments.compact(spark, at, str(tmp_path / "compact"))
    done = segments.SegmentedIndex(spark, str(tmp_path / "compact"))
    assert state(done) == want and done.totals["dead_chunks"] == 0
    ids = [r["id"] - done.segments[-1] * segments.SPAN for r in done.chunks.orderBy("path", "section", "window").collect()]
    assert ids == list(range(len(want[0])))
    # The compacted index takes changes too.
    segments.add(spark, str(tmp_path / "compact"), 9, spark.createDataFrame([("v1", p, None) for p in last], DOCS))
    assert state(segments.SegmentedIndex(spark, str(tmp_path / "compact")))[0] == []


def test_only_new_documents_are_chunked(spark, tmp_path):
    """A segment's chunks are those of its documents; an unfinished segment isn't seen; embeddings are kept."""
    at = str(tmp_path / "index")
    segments.create(spark, at, buckets=2, parts=2, embed_model="hashing-8")
    segments.add(spark, at, 0, spark.createDataFrame([("v1", "a.md", "one"), ("v1", "b.md", "two")], DOCS))
    segments.add(spark, at, 5, spark.createDataFrame([("v1", "b.md", "three")], DOCS))
    sizes = {r["segment"]: (r["chunks"], r["dead_chunks"]) for r in spark.read.schema(segments.SIZES).parquet(f"{at}/sizes").collect()}
    assert sizes == {0: (2, 0), 5: (1, 1)}
    spark.createDataFrame([("v1", "c.md", False, 9, 1, 1)], segments.DOCS.replace(", segment long", "")).write.parquet(f"{at}/docs/segment=7")
    index = segments.SegmentedIndex(spark, at)
    assert index.segments == [0, 5] and {r["content"] for r in index.chunks.collect()} == {"one", "three"}
    assert all(len(r["embedding"]) == 8 for r in index.chunks.collect())


WHO = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}


def run(folder, *args):
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env={**os.environ, **WHO})


def commit(folder, files: dict) -> None:
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.unlink() if text is None else path.write_text(text)
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", "x", "--allow-empty")


def test_index_follows_a_branch(spark, tmp_path):
    origin, clone, at, point = tmp_path / "origin", tmp_path / "clone", str(tmp_path / "index"), str(tmp_path / "point")
    origin.mkdir()
    run(origin, "init", "-q", "-b", "v1")
    commit(origin, {"readme.txt": "no Markdown yet"})
    git.clone(f"file://{origin}", clone)

    def follow() -> dict:
        git.fetch(clone)
        reindex.follow_branch(spark, str(clone), "v1", at, point).awaitTermination()
        return {r["path"]: r["content"] for r in segments.SegmentedIndex(spark, at).chunks.collect()}

    assert follow() == {}
    commit(origin, {"markdown/a/é x.md": "one", "markdown/b.md": "two", "markdown/c.txt": "no"})
    assert follow() == {"a/é x.md": "one", "b.md": "two"}
    commit(origin, {"markdown/a/é x.md": "one more", "markdown/b.md": None, "markdown/d.md": "four"})
    commit(origin, {"markdown/e.md": "five"})
    now = {"a/é x.md": "one more", "d.md": "four", "e.md": "five"}
    assert follow() == now and follow() == now
    sizes = spark.read.schema(segments.SIZES).parquet(f"{at}/sizes").agg(F.sum("chunks"), F.sum("dead_chunks")).first()
    assert tuple(sizes) == (5, 2)
    # A branch that is rewound takes back what came after.
    run(origin, "reset", "-q", "--hard", "HEAD~1")
    assert follow() == {"a/é x.md": "one more", "d.md": "four"}
    # A batch whose commit in the checkpoint is lost is taken again, with the same rows.
    last = max((p for p in os.listdir(f"{point}/commits") if p.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.path.exists(f"{point}/commits/{name}") and os.remove(f"{point}/commits/{name}")
    assert follow() == {"a/é x.md": "one more", "d.md": "four"}
