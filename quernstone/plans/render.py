"""Results as text and JSON; also as columns, for many results at once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_HITS, HITS = "No documentation results found.", "Documentation search results:\n"
HINT = "To read a result, fetch its path; add a version for another release."
NO_VERSIONS, VERSIONS = "No documentation versions found.", "Documentation versions (newest first):\n"
VERSIONS_HINT = "\nSearch covers the latest release. Fetch any version by naming it."


def search_text(hits: list[dict]) -> str:
    if not hits:
        return NO_HITS
    lines = [HITS]
    for i, h in enumerate(hits, 1):
        lines.append(f"{i}. {h['title']}{' — ' + h['breadcrumb'] if h['breadcrumb'] else ''} ({h['release']})")
        lines += [f"   {h['snippet']}"] if h["snippet"] else []
        lines += [f"   url: {h['url']}", f"   path: {h['path']}", ""]
    return "\n".join([*lines, HINT])


def fetch_text(found: dict) -> str:
    return f"> Source: {found['source_url']} (release: {found['release']})\n\n{found['markdown']}"


def versions_text(rows: list[dict]) -> str:
    if not rows:
        return NO_VERSIONS
    return "\n".join([VERSIONS, *[f"- {r['release']}{'  (latest)' if r['is_latest'] else ''}" for r in rows], VERSIONS_HINT])


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def json_column(*names: str) -> Column:
    """A row's fields as one line of JSON, in this order."""
    return F.to_json(F.struct(*names))


def hit_text() -> Column:
    """The lines of one hit (rank, title, breadcrumb, release, snippet, url, path)."""
    where = F.when(F.col("breadcrumb") == "", "").otherwise(F.concat(F.lit(" — "), F.col("breadcrumb")))
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), where, F.lit(" ("), F.col("release"), F.lit(")\n"))
    said = F.when(F.col("snippet") == "", "").otherwise(F.concat(F.lit("   "), F.col("snippet"), F.lit("\n")))
    return F.concat(head, said, F.lit("   url: "), F.col("url"), F.lit("\n   path: "), F.col("path"), F.lit("\n"))


def search_texts(hits: DataFrame) -> DataFrame:
    """(query_id, body): the text of each query's hits, a page of them at most."""
    rows = hits.select("query_id", F.struct("rank", hit_text().alias("t")).alias("h")).groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return rows.select("query_id", F.concat(F.lit(HITS + "\n"), F.array_join(F.transform("hs", lambda h: h["t"]), "\n"), F.lit("\n" + HINT)).alias("body"))


def fetch_column() -> Column:
    return F.concat(F.lit("> Source: "), F.col("source_url"), F.lit(" (release: "), F.col("release"), F.lit(")\n\n"), F.col("markdown"))


def version_line() -> Column:
    return F.concat(F.lit("- "), F.col("release"), F.when(F.col("is_latest"), "  (latest)").otherwise(""))
