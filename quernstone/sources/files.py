"""Folders of Markdown files, and documents over HTTP."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import HTTP_SECONDS, MARKDOWN_PREFIX


def markdown_folder(spark: SparkSession, folder: str, release: str) -> DataFrame:
    """(release, path, content, commit) of all ``.md`` files below ``folder``, in any store that Spark reads.

    Bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^.*?{root.replace('.', '[.]')}/", "")
    return files.select(F.lit(release).alias("release"), path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.lit("").alias("commit"))


def get_text(url: str, seconds: float = HTTP_SECONDS) -> str | None:
    """A page's text; None for anything but status 200 and for transport errors."""
    try:
        with urllib.request.urlopen(url, timeout=seconds) as r:
            return r.read().decode("utf-8", "replace") if r.status == 200 else None
    except (urllib.error.URLError, OSError, ValueError):
        return None


def fetch_raw(path: str, branch: str, base: str, get=get_text) -> str | None:
    """A document over HTTP; None for a miss or a blank page."""
    text = get(f"{base}/{branch}/{MARKDOWN_PREFIX}{path.removeprefix(MARKDOWN_PREFIX)}")
    return text if text and text.strip() else None
