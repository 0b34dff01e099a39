"""Keeping clone and index fresh: a pure decision, and the steps around it."""

from __future__ import annotations

import json
import sys
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from quernstone.config import REFRESH_SECONDS, RECLONE_SECONDS, Config
from quernstone.operators import catalog, embed
from quernstone.plans import index, segments
from quernstone.sources import git
from quernstone.streaming import reindex

#: Segments beyond which an index is compacted.
MOST_SEGMENTS = 32


def log(text: str) -> None:
    print(text, file=sys.stderr)


def read_state(config: Config) -> dict:
    try:
        found = json.loads(config.state_path.read_text())
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def write_state(config: Config, **changes: float) -> None:
    index.write_json(config.state_path, read_state(config) | changes)


def _seconds(state: dict, key: str) -> float:
    value = state.get(key)
    return float(value) if isinstance(value, (int, float)) else 0.0


def due(state: dict, key: str, now: float, every: float) -> bool:
    return now - _seconds(state, key) > every


def decide(manifest_commit: str | None, tip: str, no_index: bool, need_index: bool, index_there: bool) -> str:
    """``build``, ``keep`` or ``missing``: what to do about the index, by commit alone."""
    if manifest_commit != tip:
        if not no_index:
            return "build"
        return "missing" if need_index and not index_there else "keep"
    return "missing" if need_index and not index_there else "keep"


def latest(spark: SparkSession, config: Config) -> str:
    return catalog.latest_release(git.refs(spark, config.clone_dir)).first()["release"]


def build_branch(spark: SparkSession, config: Config, branch: str | None = None) -> index.Manifest:
    branch = (branch or latest(spark, config)).lower()
    if config.incremental:
        return update_branch(spark, config, branch)
    return index.build(spark, git.documents(spark, config.clone_dir, branch), branch, git.tip_commit(config.clone_dir, branch), config)


def update_branch(spark: SparkSession, config: Config, branch: str) -> index.Manifest:
    """The index in segments of ``branch`` up to its tip: only what changed since the last update is chunked and embedded.

    The stream's checkpoint knows the commit that is in the index. Where most chunks are dead, or
    segments are many, what is live is written anew as one segment, and later updates go there.
    """
    root, before = config.index_uri, index.read_manifest(config)
    mine = before is not None and before.version.startswith(index.SEGMENTED) and before.branch == branch and before.embed_model == embed.info(spark, config.embed_model)[0]
    version = before.version if mine else f"{index.SEGMENTED}{uuid.uuid4().hex}"
    # The checkpoint stays with the first folder, whatever is compacted later.
    first = version.split(".")[0]
    segments.create(spark, f"{root}/{version}", embed_model=config.embed_model)
    reindex.follow_branch(spark, str(config.clone_dir), branch, f"{root}/{version}", f"{root}/{first}.checkpoint").awaitTermination()
    live = segments.SegmentedIndex(spark, f"{root}/{version}")
    if len(live.segments) > MOST_SEGMENTS or live.totals["dead_chunks"] * 2 > live.totals["chunks"]:
        version = f"{first}.{uuid.uuid4().hex}"
        segments.compact(spark, live.at, f"{root}/{version}")
        live = segments.SegmentedIndex(spark, f"{root}/{version}")
    model, dim = embed.info(spark, config.embed_model)
    count = live.totals["chunks"] - live.totals["dead_chunks"]
    made = index.Manifest(branch, git.tip_commit(config.clone_dir, branch), model, datetime.now(timezone.utc).isoformat(), count, live.docs.count(), dim, version, before.version if before and before.version != version else "")
    index.publish(spark, made, config)
    return made


def _refresh(spark: SparkSession, config: Config, no_index: bool, force: bool, sync: bool, need_index: bool) -> None:
    if force or due(read_state(config), "last_fetch", time.time(), REFRESH_SECONDS):
        log("Refreshing the clone ...")
        try:
            git.fetch(config.clone_dir)
            write_state(config, last_fetch=time.time())
        except git.GitError as e:
            if e.corrupt:
                raise
            log(f"Refresh failed ({e}); the clone stays as it is.")
    if not sync:
        return
    branch = latest(spark, config)
    tip, made = git.tip_commit(config.clone_dir, branch), index.read_manifest(config)
    step = decide(made.commit if made else None, tip, no_index, need_index, index.exists(config))
    if step == "missing":
        raise FileNotFoundError("No search index found; build it, or allow building.")
    if step == "build":
        log(f"Documents changed ({branch} @ {tip[:8]}); building the index ...")
        build_branch(spark, config, branch)


def ensure_ready(spark: SparkSession, config: Config, no_index: bool = False, force: bool = False, sync: bool = True, need_index: bool = True) -> None:
    """First clone, refresh, build; a clone with missing objects is cloned anew, at most once in RECLONE_SECONDS."""
    if not git.is_cloned(config.clone_dir):
        log("First run: cloning ...")
        git.clone(config.git_url, config.clone_dir)
        write_state(config, last_fetch=time.time())
    try:
        _refresh(spark, config, no_index, force, sync, need_index)
    except git.GitError as e:
        if not e.corrupt:
            raise
        if not due(read_state(config), "last_reclone", time.time(), RECLONE_SECONDS):
            log("The clone is incomplete but was cloned anew lately; going on with it.")
            return
        log("The clone is incomplete; cloning anew ...")
        git.reclone(config.git_url, config.clone_dir)
        write_state(config, last_fetch=time.time(), last_reclone=time.time())
        _refresh(spark, config, no_index, force, sync, need_index)
