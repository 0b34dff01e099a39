"""String and path functions over columns. White space and word classes are Unicode's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.config import MARKDOWN_PREFIX, SNIPPET_CHARS


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_ws(s: Column) -> Column:
    """Without white space at both ends, line ends and no-break spaces included."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def slug(heading: Column) -> Column:
    """An anchor: lower case, word characters and dashes, white space to single dashes."""
    return F.regexp_replace(trim_ws(F.regexp_replace(F.lower(heading), r"(?U)[^\w\s-]", "")), r"(?U)\s+", "-")


def snippet(content: Column, chars: int = SNIPPET_CHARS) -> Column:
    return trim_ws(F.substring(F.regexp_replace(content, r"(?U)\s+", " "), 1, chars))


def first_filled(*columns: Column) -> Column:
    """The first that isn't empty, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def docs_url(path: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/r/"), F.regexp_replace(path, r"\.md\z", ""))


def hit_url(path: Column, anchor: Column, canonical: Column, base: str) -> Column:
    plain = F.when(canonical == "", docs_url(path, base)).otherwise(canonical)
    return F.when(anchor == "", plain).otherwise(F.concat(plain, F.lit("#"), anchor))


def strip_markdown_prefix(path: Column) -> Column:
    return F.regexp_replace(path, f"^{MARKDOWN_PREFIX}", "")


def raw_url(branch: Column, path: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/"), branch, F.lit(f"/{MARKDOWN_PREFIX}"), strip_markdown_prefix(path))


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 8)


# What is taken off a source, in this order, to leave a path.
NOT_PATH = (r"^https?://[^/]+/docs/", r"^https?://[^/]+/", r"^/+", r"^r/", f"^{MARKDOWN_PREFIX}", r"\.html\z")


def repo_path(source: Column, releases: Iterable[str] | Column, strip_fragment: bool = False) -> Column:
    """struct(repo_path, release_in_path) of a docs URL, reader path or repository path.

    strip_fragment: an extension that also drops ``?query`` and ``#fragment``.
    """
    p = trim_ws(source)
    if strip_fragment:
        p = F.regexp_replace(p, r"[?#].*", "")
    for pattern in NOT_PATH:
        p = F.regexp_replace(p, pattern, "")
    known = releases if isinstance(releases, Column) else F.array(*[F.lit(r) for r in releases]).cast("array<string>")

    def split(parts: Column) -> Column:
        inside = (F.size(parts) > 1) & F.array_contains(known, parts[0])
        path = F.array_join(F.when(inside, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts), "/")
        path = F.when((path != "") & ~path.endswith(".md"), F.concat(path, F.lit(".md"))).otherwise(path)
        return F.struct(path.alias("repo_path"), F.when(inside, parts[0]).alias("release_in_path"))

    return let(F.split(p, "/"), split)
