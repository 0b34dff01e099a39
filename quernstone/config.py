"""Settings: everything that names a place or a limit, with overrides from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path

# Names of branches that are never releases, and a part of a name that marks one.
NON_RELEASE = ("main", "master", "HEAD", "gh-pages", "origin", "nofamily", "mobile", "other", "store")
FEATURE_MARK = "feature/"
# Chunk sizes in characters, snippet length, and the ranking's constants.
MAX_CHARS, OVERLAP_CHARS, SNIPPET_CHARS = 1600, 160, 240
RRF_K, POOL_FACTOR, POOL_LEAST, DEFAULT_LIMIT = 60, 4, 40, 8
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
MARKDOWN_PREFIX, DEFAULT_BRANCH, EMBED_DIM = "markdown/", "main", 512
REFRESH_SECONDS, RECLONE_SECONDS, HTTP_SECONDS = 24 * 3600.0, 30 * 24 * 3600.0, 30.0


def _env(name: str, default: str) -> str:
    return os.environ.get(f"QUERNSTONE_{name}", default)


@dataclass(frozen=True)
class Config:
    """Read anew by ``Config.load()``, so that the environment may change between calls."""

    data_dir: Path = field(default_factory=lambda: Path.home() / ".quernstone")
    git_url: str = ""
    docs_base: str = "https://docs.example.org"
    raw_base: str = "https://raw.example.org"
    embed_model: str = "hashing"
    live: bool = False
    max_files: int | None = None
    tables: str = ""
    incremental: bool = False

    @classmethod
    def load(cls, **overrides) -> Config:
        cap = _env("INDEX_MAX_FILES", "")
        found = cls(
            data_dir=Path(_env("DATA_DIR", str(cls().data_dir))),
            git_url=_env("GIT_URL", ""),
            docs_base=_env("DOCS_BASE", cls.docs_base),
            raw_base=_env("RAW_BASE", cls.raw_base),
            embed_model=_env("EMBED_MODEL", cls.embed_model),
            live=_env("FETCH_SOURCE", "").strip().lower() == "live",
            max_files=int(cap) if cap.strip().isdigit() else None,
            tables=_env("INDEX_TABLES", ""),
            incremental=_env("INDEX_INCREMENTAL", "").strip().lower() in ("1", "true", "yes"),
        )
        return replace(found, **{k: v for k, v in overrides.items() if v is not None})

    @property
    def clone_dir(self) -> Path:
        return self.data_dir / "clone"

    @property
    def index_dir(self) -> Path:
        return self.data_dir / "index"

    @property
    def index_uri(self) -> str:
        """Where the index's tables are: a folder of any store that Spark reads (``tables``), which a cluster needs, or the data folder."""
        return self.tables.rstrip("/") or self.index_dir.absolute().as_uri()

    @property
    def state_path(self) -> Path:
        return self.data_dir / "state.json"
