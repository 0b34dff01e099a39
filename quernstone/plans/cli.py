"""Command line: python -m quernstone.plans.cli COMMAND."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quernstone.config import DEFAULT_LIMIT, Config
from quernstone.plans import index, lifecycle, render, server
from quernstone.plans.service import Service
from quernstone.sources import git


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernstone")
    p.add_argument("--data-dir", type=Path)
    p.add_argument("--no-index", action="store_true")
    p.add_argument("-V", "--version", action="version", version="quernstone 0.1.0")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-n", "--limit", type=int, default=DEFAULT_LIMIT)
    for name, what in (("fetch", "path"), ("fetch-url", "url")):
        c = sub.add_parser(name)
        c.add_argument("source", metavar=what)
        c.add_argument("-v", "--release", default=None)
        c.add_argument("--live", action="store_true")
    sub.add_parser("list-versions")
    c = sub.add_parser("index")
    c.add_argument("-b", "--branch")
    c.add_argument("-f", "--force", action="store_true")
    c = sub.add_parser("update")
    c.add_argument("--no-index", dest="skip_index", action="store_true")
    c = sub.add_parser("serve")
    c.add_argument("--http", metavar="HOST:PORT")
    c.add_argument("--token", default=None)
    sub.add_parser("doctor")
    for name, c in sub.choices.items():
        if name in ("search", "fetch", "fetch-url", "list-versions"):
            c.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quernstone").getOrCreate()
    config = Config.load(data_dir=args.data_dir)
    service = Service(spark, config)
    try:
        if args.command == "search":
            service.ready(no_index=args.no_index, sync=True, need_index=True)
            hits = service.search(args.query, max(args.limit, 0))
            print(render.as_json(hits) if args.json else render.search_text(hits))
        elif args.command in ("fetch", "fetch-url"):
            service.ready(no_index=args.no_index, sync=False, need_index=False)
            found = service.fetch(args.source, args.release, args.live)
            print(render.as_json(found) if args.json else render.fetch_text(found))
        elif args.command == "list-versions":
            service.ready(no_index=args.no_index, sync=False, need_index=False)
            rows = service.list_versions()
            print(render.as_json(rows) if args.json else render.versions_text(rows))
        elif args.command == "index":
            service.ready(no_index=True, sync=False, need_index=False)
            branch = (args.branch or lifecycle.latest(spark, config)).lower()
            made = index.read_manifest(config)
            if not args.force and made and made.commit == git.tip_commit(config.clone_dir, branch):
                print(f"Index is up to date ({made.branch} @ {made.commit[:8]}).")
            else:
                made = lifecycle.build_branch(spark, config, branch)
                print(f"Indexed {made.chunk_count} chunks of {made.file_count} files ({made.branch} @ {made.commit[:8]}).")
        elif args.command == "update":
            service.ready(no_index=args.no_index or args.skip_index, force=True, sync=True, need_index=False)
            print("Up to date.")
        elif args.command == "serve":
            token = args.token if args.token is not None else os.environ.get("QUERNSTONE_TOKEN", "")
            if args.http and not token:
                raise ValueError("serving over HTTP needs --token or QUERNSTONE_TOKEN")
            service.ready(no_index=False, sync=True, need_index=True)
            # A server reads pages over HTTP unless the setting says otherwise.
            made = server.Server(service, live="QUERNSTONE_FETCH_SOURCE" not in os.environ or config.live)
            if args.http:
                host, _, port = args.http.rpartition(":")
                with made.http(host or "127.0.0.1", int(port), token) as listening:
                    listening.serve_forever()
            else:
                made.stdio()
        else:
            fine, report = service.doctor()
            print(render.as_json(report))
            return 0 if fine else 1
    except (LookupError, FileNotFoundError, ValueError, git.GitError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
