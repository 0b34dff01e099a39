"""Search, fetch and listing over one configuration: what the command line and a server call."""

from __future__ import annotations

import hmac
import importlib.util
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernstone.config import DEFAULT_LIMIT, Config
from quernstone.functions.tokenize import stem
from quernstone.functions.vectors import l2_distance
from quernstone.operators import catalog, embed, hybrid
from quernstone.operators.markdown import parse_docs
from quernstone.plans import index, lifecycle
from quernstone.sources import files, git


class Service:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config.load()

    def search(self, query: str, limit: int = DEFAULT_LIMIT) -> list[dict]:
        """Hits by rank; a blank query has none and opens nothing."""
        query = query.strip()
        if not query:
            return []
        vector = embed.query(query, self.config.embed_model, self.spark)
        opened = index.open_index(self.spark, self.config)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        near = self.spark.createDataFrame([(0, vector)], "query_id long, embedding array<double>")
        rows = hybrid.search_one(opened.lexical, opened.chunks, opened.vectors, asked, near, limit, self.config.docs_base)
        return [{k: r[k] for k in hybrid.HIT} for r in rows.orderBy("rank").collect()]

    def refs(self):
        return git.refs(self.spark, self.config.clone_dir)

    def list_versions(self) -> list[dict]:
        rows = catalog.versions(self.refs()).orderBy("ord").collect()
        return [{"release": r["release"], "is_latest": r["is_latest"]} for r in rows]

    def fetch(self, source: str, version: str | None = None, live: bool = False, get=files.get_text) -> dict:
        """One document; LookupError if there is none."""
        asked = self.spark.createDataFrame([(0, source, version)], "request_id int, source string, version string")
        where = catalog.resolve(asked, self.refs()).first()
        path, release = where["repo_path"], where["release"]
        if not path:
            raise LookupError(f"{source!r} names no document.")
        over_http = lambda: files.fetch_raw(path, release, self.config.raw_base, get)
        if live or self.config.live:
            text = over_http()
        else:
            text = git.read_doc(self.config.clone_dir, release, path) if git.is_cloned(self.config.clone_dir) else over_http()
        if text is None:
            raise LookupError(f"No document found at '{path}' on branch '{release}'.")
        parsed = parse_docs(self.spark.createDataFrame([(text,)], "content string")).first()
        title, body = parsed["meta"]["title"], parsed["body"].strip()
        url = parsed["meta"]["canonical_url"] or f"{self.config.docs_base}/r/{path.removesuffix('.md')}"
        head = f"# {title}\n\n" if title and not body.startswith("#") else ""
        return {"markdown": head + body, "source_url": url, "path": path, "release": release}

    def ready(self, **flags) -> None:
        lifecycle.ensure_ready(self.spark, self.config, **flags)

    def doctor(self) -> tuple[bool, dict]:
        made = index.read_manifest(self.config)
        report = {
            "spark": self.spark.version, "git": shutil.which("git") or "", "data_dir": str(self.config.data_dir), "cloned": git.is_cloned(self.config.clone_dir),
            "index": index.exists(self.config), **self.capabilities(), "branch": made.branch if made else "", "commit": made.commit[:8] if made else "", "embedder": embed.describe(self.config.embed_model, self.spark),
        }
        return bool(report["git"] and report["words"] and report["vectors"]), report

    def capabilities(self) -> dict[str, bool]:
        """Whether what search needs works here: stemmed terms through a Python worker, vector distances, YAML."""

        def works(probe) -> bool:
            try:
                return bool(probe())
            except Exception:  # whatever is missing shows as an error of its own kind
                return False

        one = self.spark.range(1)
        pair = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))
        return {
            "words": works(lambda: one.select(stem(F.lit("flows"))).first()[0] == "flow"),
            "vectors": works(lambda: one.select(l2_distance(*pair)).first()[0] == 5.0),
            "yaml": works(lambda: importlib.util.find_spec("yaml")),
        }


def same_token(given: str, expected: str) -> bool:
    """Compared in constant time, for a server's bearer tokens."""
    return hmac.compare_digest(given.encode(), expected.encode())
