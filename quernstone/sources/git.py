"""A git repository as tables: refs, and the documents of a branch's tip."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quernstone.config import MARKDOWN_PREFIX

DOCS_SCHEMA = "release string, path string, content string, commit string"
REFS_SCHEMA = "name string, committed_at bigint, commit string, is_default boolean"
#: In English, as git is run in the C locale: objects that a clone lacks though it names them show as one of these.
_BROKEN = ("bad object", "missing blob", "missing tree", "could not read", "unable to read", "object file", "corrupt", "does not exist in", "invalid object", "not found in pack")


class GitError(RuntimeError):
    @property
    def corrupt(self) -> bool:
        """Whether the clone's own objects are at fault, not the network."""
        text = str(self).lower()
        return any(b in text for b in _BROKEN)


def git(folder: str | Path, *args: str, data: bytes | None = None, timeout: float = 600) -> bytes:
    try:
        done = subprocess.run(["git", "-C", str(folder), *args], input=data, capture_output=True, timeout=timeout, env=os.environ | {"LC_ALL": "C"})
    except subprocess.TimeoutExpired as e:
        raise GitError(f"git {args[0]} took longer than {timeout:g} s") from e
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def is_cloned(folder: str | Path) -> bool:
    return (Path(folder) / ".git").is_dir()


def fetch(folder: str | Path) -> None:
    """All heads, forced, without tags; the default branch's symref as the origin has it. Deleted branches stay."""
    git(folder, "fetch", "--no-tags", "--quiet", "origin", "+refs/heads/*:refs/remotes/origin/*")
    try:
        git(folder, "remote", "set-head", "origin", "--auto")
    except GitError:
        pass  # best effort, as the origin may have no default branch


def clone(url: str, folder: str | Path) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    git(folder, "init", "--quiet")
    git(folder, "remote", "add", "origin", url)
    fetch(folder)


def sibling(folder: str | Path, suffix: str) -> Path:
    folder = Path(folder)
    return folder.with_name(folder.name + suffix)


def reclone(url: str, folder: str | Path) -> None:
    """A fresh clone beside the old one takes its place; the old one goes last."""
    new, old = sibling(folder, ".reclone-tmp"), sibling(folder, ".old")
    for stale in (new, old):
        shutil.rmtree(stale, ignore_errors=True)
    clone(url, new)
    if Path(folder).exists():
        Path(folder).rename(old)
    new.rename(folder)
    shutil.rmtree(old, ignore_errors=True)


def ref_rows(folder: str | Path) -> list[tuple[str, int, str, bool]]:
    """(name, committed_at, commit, is_default) of the origin's branches; refs that can't be read are left out."""
    if not is_cloned(folder):
        return []
    try:
        head = git(folder, "symbolic-ref", "refs/remotes/origin/HEAD").decode().strip()
    except GitError:
        head = ""
    listed = git(folder, "for-each-ref", "--format=%(refname)%00%(committerdate:unix)%00%(objectname)", "refs/remotes/origin/").decode("utf-8", "replace")
    rows = []
    for line in listed.splitlines():
        name, at, commit = line.split("\0")
        short = name.removeprefix("refs/remotes/origin/")
        if short != "HEAD" and at.strip().isdigit():
            rows.append((short, int(at), commit, name == head))
    return rows


def refs(spark: SparkSession, folder: str | Path) -> DataFrame:
    return spark.createDataFrame(ref_rows(folder), REFS_SCHEMA)


def tip_commit(folder: str | Path, branch: str) -> str:
    return git(folder, "rev-parse", "--verify", f"refs/remotes/origin/{branch}^{{commit}}").decode().strip()


def read_doc(folder: str | Path, branch: str, path: str) -> str | None:
    """One document's text; None for a miss or a blank file."""
    try:
        text = git(folder, "cat-file", "blob", f"refs/remotes/origin/{branch}:{MARKDOWN_PREFIX}{path.removeprefix(MARKDOWN_PREFIX)}", timeout=30).decode("utf-8", "replace")
    except GitError:
        return None
    return text if text.strip() else None


class _Range(InputPartition):
    def __init__(self, commit: str, entries: list[tuple[str, str]]):
        self.commit, self.entries = commit, entries


def blobs(folder: str | Path, branch: str, commit: str, entries: list[tuple[str, str]]) -> Iterator[tuple]:
    """Rows of DOCS_SCHEMA of (path, blob)."""
    if not entries:
        return
    out = git(folder, "cat-file", "--batch", data="".join(f"{sha}\n" for _, sha in entries).encode())
    at = 0
    for path, _ in entries:
        end = out.index(b"\n", at)
        head = out[at:end].split()
        if len(head) != 3:
            raise GitError(f"missing blob {out[at:end].decode('utf-8', 'replace')}")
        size = int(head[2])
        yield branch, path, out[end + 1 : end + 1 + size].decode("utf-8", "replace"), commit
        at = end + 2 + size


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.branch, self.size = options["path"], options["branch"], int(options.get("files_a_partition", 500))

    def partitions(self) -> list[InputPartition]:
        commit = tip_commit(self.folder, self.branch)
        try:
            listed = git(self.folder, "ls-tree", "-r", "-z", f"{commit}:{MARKDOWN_PREFIX.rstrip('/')}")
        except GitError as e:
            if e.corrupt and "does not exist in" not in str(e):
                raise
            listed = b""  # the branch has no such folder
        entries = []
        for row in filter(None, listed.split(b"\0")):
            kind, _, name = row.partition(b"\t")
            if kind.split()[1] == b"blob" and name.endswith(b".md"):
                entries.append((name.decode("utf-8", "replace"), kind.split()[2].decode()))
        entries.sort(key=lambda e: e[0].encode())
        return [_Range(commit, entries[i : i + self.size]) for i in range(0, len(entries), self.size)] or [_Range(commit, [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from blobs(self.folder, self.branch, partition.commit, partition.entries)


class GitDocuments(DataSource):
    """``spark.read.format("git_markdown").option("branch", b).load(folder)``: one partition for each range of paths.

    The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "git_markdown"

    def schema(self) -> str:
        return DOCS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def documents(spark: SparkSession, folder: str | Path, branch: str) -> DataFrame:
    spark.dataSource.register(GitDocuments)
    return spark.read.format("git_markdown").option("branch", branch).load(str(folder))


# Fixed value: git's name of the tree without entries.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def changed(folder: str | Path, start: str, end: str) -> list[tuple[str, str]]:
    """(path, blob) of the Markdown files that differ between two commits, by path; no blob where one is gone. start "": none was there."""
    listed = git(folder, "diff-tree", "-r", "-z", "--no-renames", start or EMPTY_TREE, end, "--", MARKDOWN_PREFIX).split(b"\0")
    rows = []
    for head, name in zip(listed[0::2], listed[1::2]):
        mode, blob = head.split()[1].decode(), head.split()[3].decode()
        path = name.decode("utf-8", "replace").removeprefix(MARKDOWN_PREFIX)
        if path.endswith(".md"):
            # Other modes name no file of this repository: a folder of another one, or nothing.
            rows.append((path, blob if mode.startswith(("100", "120")) else ""))
    return sorted(rows, key=lambda r: r[0].encode())


class _ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.branch, self.size = options["path"], options["branch"], int(options.get("files_a_partition", 500))

    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        return {"commit": tip_commit(self.folder, self.branch)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["commit"] == end["commit"]:
            return []
        rows = changed(self.folder, start["commit"], end["commit"])
        return [_Range(end["commit"], rows[i : i + self.size]) for i in range(0, len(rows), self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        there = [(path, blob) for path, blob in partition.entries if blob]
        yield from blobs(self.folder, self.branch, partition.commit, there)
        for path, blob in partition.entries:
            if not blob:
                yield self.branch, path, None, partition.commit


class GitChanges(DataSource):
    """``spark.readStream.format("git_changes").option("branch", b).load(folder)``: what changes in a branch, in DOCS_SCHEMA.

    An offset is a commit; a batch has the paths that differ between two commits' trees, with
    null content for those that are gone, also where the branch was rewound or its history
    rewritten. A commit that the clone no longer holds is an error: start anew with another checkpoint.
    The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return DOCS_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangeReader(dict(self.options))


def changes(spark: SparkSession, folder: str | Path, branch: str) -> DataFrame:
    spark.dataSource.register(GitChanges)
    return spark.readStream.format("git_changes").option("branch", branch).load(str(folder))
