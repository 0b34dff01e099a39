"""A real local repository: clone, versions, build, search, fetch, update, lifecycle, command line, stream."""

import os
import subprocess

import pytest

from quernstone.config import Config
from quernstone.plans import cli, index, lifecycle, render
from quernstone.plans.service import Service, same_token
from quernstone.sources import files, git
from quernstone.streaming import reindex

WHO = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}


def run(folder, *args, when="2024-01-01T00:00:00Z"):
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env={**os.environ, **WHO, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})


@pytest.fixture(scope="module")
def origin(tmp_path_factory):
    folder = tmp_path_factory.mktemp("origin")
    run(folder, "init", "-q", "-b", "v2")
    (folder / "markdown/a").mkdir(parents=True)
    (folder / "markdown/a/flow.md").write_text("---\ntitle: Flow\nbreadcrumb: [Guide, Flow]\n---\nintro\n# Make a flow\nFlows run steps in order.\n")
    (folder / "markdown/b.md").write_text("---\ntitle: Tables\ncanonical_url: https://c/b\n---\n# Tables\nA table holds records.\n")
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", "x")
    run(folder, "branch", "v1")
    run(folder, "branch", "feature/y")
    return folder


@pytest.fixture()
def service(spark, origin, tmp_path):
    return Service(spark, Config(data_dir=tmp_path / "data", git_url=f"file://{origin}", embed_model="hashing-64"))


def test_end_to_end(spark, origin, service, capsys):
    service.ready()
    made = index.read_manifest(service.config)
    assert (made.branch, made.file_count, made.chunk_count) == ("v2", 2, 3)
    hits = service.search("flows in order", 5)
    assert hits[0]["path"] == "a/flow.md" and len({h["path"] for h in hits}) == len(hits)
    assert hits[0]["url"].endswith("/r/a/flow#make-a-flow")
    assert service.search("  ") == [] and len(service.search("flow", 0)) == 1
    assert service.list_versions() == [{"release": "v2", "is_latest": True}, {"release": "v1", "is_latest": False}]
    found = service.fetch("https://h/docs/r/v1/b.html", version="nowhere")
    assert found == {"markdown": "# Tables\nA table holds records.", "source_url": "https://c/b", "path": "b.md", "release": "v1"}
    with pytest.raises(LookupError):
        service.fetch("nothing")
    (origin / "markdown/c.md").write_text("# New\nnew page about zebras\n")
    run(origin, "add", "-A", when="2024-02-01T00:00:00Z")
    run(origin, "commit", "-qm", "y", when="2024-02-01T00:00:00Z")
    assert cli.main(["--data-dir", str(service.config.data_dir), "list-versions", "--json"], spark) == 0
    service.ready(force=True)
    assert index.read_manifest(service.config).file_count == 3 and service.search("zebras")[0]["path"] == "c.md"
    fine, report = service.doctor()
    assert fine and report["words"] and report["vectors"] and report["index"]
    # The version before stays for its readers, the one before that goes.
    now = index.read_manifest(service.config)
    assert now.previous == made.version and (service.config.index_dir / made.version / "chunks").is_dir()
    lifecycle.build_branch(spark, service.config)
    assert not (service.config.index_dir / made.version).exists() and (service.config.index_dir / now.version).is_dir()
    assert "v2" in capsys.readouterr().out


def test_live_fetch_and_misses(service):
    service.ready(sync=False)
    page = lambda url: "live text" if url.endswith("/v2/markdown/z.md") else None
    assert service.fetch("z", live=True, get=page)["markdown"] == "live text"
    with pytest.raises(LookupError):
        service.fetch("y", live=True, get=page)
    assert files.get_text("http://127.0.0.1:9/x", 1) is None


@pytest.mark.parametrize(
    ("commit", "no_index", "need", "there", "step"),
    [("a", False, True, True, "keep"), ("b", False, True, True, "build"), (None, True, True, False, "missing"), ("b", True, True, True, "keep"), (None, True, False, False, "keep"), ("a", False, True, False, "missing")],
)
def test_decision(commit, no_index, need, there, step):
    assert lifecycle.decide(commit, "a", no_index, need, there) == step


def test_state_and_manifest_survive_damage(tmp_path):
    config = Config(data_dir=tmp_path)
    assert lifecycle.read_state(config) == {} and index.read_manifest(config) is None
    lifecycle.write_state(config, last_fetch=5.0)
    assert lifecycle.read_state(config) == {"last_fetch": 5.0}
    assert not lifecycle.due({"last_fetch": 0.0}, "last_fetch", 10.0, 10.0) and lifecycle.due({}, "last_fetch", 10.1, 10.0)
    config.state_path.write_text("{")
    assert lifecycle.read_state(config) == {}


def test_corrupt_clone_is_cloned_anew_once(service, monkeypatch):
    service.ready(sync=False)
    calls = []

    def broken(folder):
        calls.append(1)
        raise git.GitError("fatal: bad object HEAD")

    monkeypatch.setattr(git, "fetch", broken)
    monkeypatch.setattr(git, "reclone", lambda url, folder: monkeypatch.setattr(git, "fetch", lambda f: None))
    service.ready(sync=False, force=True)
    assert "last_reclone" in lifecycle.read_state(service.config)
    monkeypatch.setattr(git, "fetch", broken)
    service.ready(sync=False, force=True)  # within the cooldown: goes on
    assert len(calls) == 2


def test_empty_branch_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([], git.DOCS_SCHEMA)
    with pytest.raises(ValueError, match="no Markdown files"):
        index.build(spark, docs, "v1", "c", Config(data_dir=tmp_path))


def test_rendering():
    hit = {"title": "T", "breadcrumb": "", "release": "r", "snippet": "", "url": "u", "path": "p"}
    assert "1. T (r)\n   url: u\n   path: p\n" in render.search_text([hit])
    assert render.search_text([]) == render.NO_HITS and render.versions_text([]) == render.NO_VERSIONS
    assert render.as_json({"a": "é"}) == '{\n  "a": "é"\n}'
    assert same_token("x", "x") and not same_token("x", "y")


def test_stream_and_folder(spark, tmp_path):
    rows = [("r", "a.md", "# A\nx", "c")]
    spark.createDataFrame(rows, reindex.SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        reindex.keep_chunks(reindex.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["content"] for r in reindex.current(spark.read.parquet(str(tmp_path / "out"))).collect()] == ["x"]
    (tmp_path / "md/s").mkdir(parents=True)
    (tmp_path / "md/s/b.md").write_bytes(b"a\xffb")
    got = files.markdown_folder(spark, str(tmp_path / "md"), "r").first()
    assert (got["path"], got["content"]) == ("s/b.md", "a�b")


def test_two_drivers_see_what_is_published(spark, tmp_path, monkeypatch):
    """The manifest lies beside the tables: another driver, with other data, sees it; a build that breaks off changes nothing."""
    one, two = (Config(data_dir=tmp_path / d, tables=f"file://{tmp_path}/store", embed_model="hashing-8") for d in ("one", "two"))
    docs = spark.createDataFrame([("v1", "a.md", "one", "c")], git.DOCS_SCHEMA)
    made = index.build(spark, docs, "v1", "c1", one)
    assert index.read_manifest(two) == made and index.open_index(spark, two).chunks.count() == 1
    monkeypatch.setattr(index, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.build(spark, docs.unionByName(docs.withColumn("path", docs["commit"])), "v1", "c2", two)
    monkeypatch.undo()
    assert index.read_manifest(one) == made and index.open_index(spark, one).chunks.count() == 1
    newer = index.build(spark, docs.unionByName(docs.withColumn("path", docs["commit"])), "v1", "c2", two)
    assert index.read_manifest(one) == newer and newer.previous == made.version and index.open_index(spark, one).chunks.count() == 2


def test_incremental_updates(spark, tmp_path, monkeypatch):
    """Updates of an index in segments: searches see the tip, older texts are neither found nor embedded again, compaction changes nothing."""
    folder = tmp_path / "origin"
    (folder / "markdown").mkdir(parents=True)
    run(folder, "init", "-q", "-b", "v1")
    for name, text in (("a", "# Flow\nflows run steps"), ("b", "# Table\ntables hold records"), ("c", "# Zebra\nzebras run")):
        (folder / f"markdown/{name}.md").write_text(text)
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", "x")
    service = Service(spark, Config(data_dir=tmp_path / "data", git_url=f"file://{folder}", embed_model="hashing-16", incremental=True))
    service.ready()
    made = index.read_manifest(service.config)
    assert made.version.startswith(index.SEGMENTED) and (made.file_count, made.chunk_count) == (3, 3)
    assert service.search("zebras")[0]["path"] == "c.md"
    (folder / "markdown/c.md").write_text("# Lion\nlions sleep")
    (folder / "markdown/b.md").unlink()
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", "y")
    service.ready(force=True)
    now = index.read_manifest(service.config)
    assert now.version == made.version and (now.file_count, now.chunk_count) == (2, 2) and now.commit != made.commit
    assert {h["path"] for h in service.search("zebras lions tables")} == {"a.md", "c.md"} and "zebra" not in str(service.search("zebras")).lower()
    monkeypatch.setattr(lifecycle, "MOST_SEGMENTS", 1)
    (folder / "markdown/d.md").write_text("# Bear\nbears eat")
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", "z")
    service.ready(force=True)
    last = index.read_manifest(service.config)
    assert last.version != made.version and (last.file_count, last.chunk_count) == (3, 3)
    assert service.search("bears")[0]["path"] == "d.md" and index.open_index(spark, service.config).vectors.count() == 3
    assert lifecycle.build_branch(spark, service.config).version.split(".")[0] == made.version
