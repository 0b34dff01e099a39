"""Markdown documents to chunks: frontmatter, sections, windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quernstone.config import MAX_CHARS, OVERLAP_CHARS
from quernstone.functions.text import let, slug, trim_ws
from quernstone.shared import written

META = ("title", "breadcrumb", "canonical_url", "last_updated")
CHUNK = ("path", "anchor", "title", "breadcrumb", "heading", "release", "content", "canonical_url", "last_updated")
#: First ids of up to so many documents are broadcast (16 MB); documents of a range.
DOCUMENTS, RANGE = 1 << 20, 250_000
# Plain scalars of YAML 1.2's core schema.
_NULL = re.compile(r"(~|null|Null|NULL)?\Z")
_BOOL = re.compile(r"(true|True|TRUE|false|False|FALSE)\Z")
_INT = re.compile(r"[-+]?(0|[1-9][0-9]*)\Z|0o[0-7]+\Z|0x[0-9a-fA-F]+\Z")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|(0|[1-9][0-9]*)(\.[0-9]*)?)([eE][-+]?[0-9]+)?\Z")


def _scalar(node) -> str:
    text = node.value
    if node.style is not None or node.tag.startswith("!"):
        return text
    if _NULL.match(text):
        return ""
    if _BOOL.match(text):
        return text.capitalize()
    if _INT.match(text):
        return str(int(text, 0) if text[:2] in ("0o", "0x") else int(text))
    return repr(float(text)) if _FLOAT.match(text) else text


def yaml_fields(source: str) -> dict[str, str] | None:
    """META fields of a YAML document as text: lists joined by " > ", booleans as True and False; None if it is no YAML."""
    import yaml

    try:
        root = yaml.compose(source, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return None
    out = dict.fromkeys(META, "")
    if not isinstance(root, yaml.MappingNode):
        return out
    seen = set()
    for key, value in root.value:
        if isinstance(key, yaml.ScalarNode):
            if key.value in seen:
                return None  # a key that stands twice is an error
            seen.add(key.value)
            if key.value in out:
                if isinstance(value, yaml.SequenceNode):
                    out[key.value] = " > ".join(_scalar(v) if isinstance(v, yaml.ScalarNode) else "" for v in value.value)
                elif isinstance(value, yaml.ScalarNode):
                    out[key.value] = _scalar(value)
    return out


@F.pandas_udf(StructType([StructField(k, StringType()) for k in META]))
def _fields(source: pd.Series) -> pd.DataFrame:
    rows = [yaml_fields(s) if s is not None else None for s in source]
    return pd.DataFrame([r or dict.fromkeys(META) for r in rows], columns=list(META), dtype=object)





#: The text begins with a line of dashes; its white space may take blank lines with it. A second one ends the YAML (1), the body follows (2).
FENCED = r"(?dmsU)\A(?>-{3,}\s*$)(.*?)(?>^-{3,}\s*$)\n?(.*)\z"


def parse_docs(docs: DataFrame, markdown: str = "content") -> DataFrame:
    """``docs`` with meta (a struct of META, "" where missing) and body; without valid frontmatter body is the whole text.

    Only the YAML itself goes to Python; texts and boundaries stay in the JVM.
    """
    raw = F.col(markdown)
    fenced = raw.startswith("---") & raw.rlike(FENCED)
    cut = docs.withColumn("_yaml", F.when(fenced, F.regexp_extract(raw, FENCED, 1)))
    cut = cut.withColumn("_meta", _fields("_yaml"))
    valid = F.col("_yaml").isNotNull() & F.col("_meta.title").isNotNull()
    body = F.when(valid, F.regexp_extract(raw, FENCED, 2)).otherwise(raw)
    meta = F.struct(*[F.when(valid, F.col(f"_meta.{k}")).otherwise("").alias(k) for k in META])
    return cut.withColumn("meta", meta).withColumn("body", body).drop("_yaml", "_meta")


def sections(body: Column) -> Column:
    """array of struct(heading, text): the body cut at lines of one to three # and a heading."""
    heads = r"(?U)\A#{1,3}[^\S\n]"
    parts = F.split(F.concat(F.lit("\n"), body), r"(?U)\n(?=#{1,3}(?:[^\S\n]))")

    def section(part: Column, i: Column) -> Column:
        headed = (i > 0) & part.rlike(heads)
        first = F.regexp_extract(part, r"(?U)\A#{1,3}[^\S\n]+([^\n]*)", 1)
        rest = F.regexp_replace(part, r"\A[^\n]*", "")
        return F.struct(F.when(headed, trim_ws(first)).otherwise("").alias("heading"), trim_ws(F.when(headed, rest).otherwise(part)).alias("text"))

    return F.filter(F.transform(parts, section), lambda s: (s["text"] != "") | (s["heading"] != ""))


def windows(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Overlapping windows of at most ``most`` characters, cut between paragraphs where possible."""
    step = most - overlap

    def add(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) + 2 > most)
        tail = F.when(F.length(acc["cur"]) > overlap, F.substring(acc["cur"], -overlap, overlap)).otherwise(acc["cur"])
        out = F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cur = let(F.when(full, tail).otherwise(acc["cur"]), lambda c: F.when(c == "", p).otherwise(F.concat(c, F.lit("\n\n"), p)))

        def settle(c: Column) -> Column:
            k = F.greatest(F.ceil((F.length(c) - most) / step), F.lit(0)).cast("int")
            cuts = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.substring(c, i * step + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(out, cuts).alias("out"), F.substring(c, k * step + 1, F.length(c)).alias("cur"))

        return let(cur, settle)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    end = lambda acc: F.when(trim_ws(acc["cur"]) != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(F.split(text, r"\n{2,}"), start, add, end))


def chunk_docs(docs: DataFrame) -> DataFrame:
    """Chunks (CHUNK columns, section, window, and nth in the document from 0) of ``docs`` (release, path, content); no shuffle."""
    parsed = parse_docs(docs).withColumn("sections", sections(F.col("body")))
    cut = F.flatten(
        F.transform(
            "sections",
            lambda s, i: F.transform(windows(s["text"]), lambda w, j: F.struct(i.alias("section"), j.alias("window"), s["heading"].alias("heading"), trim_ws(w).alias("content"), F.lit(False).alias("titled"))),
        )
    )
    cut = F.filter(cut, lambda c: (c["content"] != "") | (c["heading"] != ""))
    alone = F.array(F.struct(F.lit(0).alias("section"), F.lit(0).alias("window"), F.col("meta.title").alias("heading"), F.col("meta.breadcrumb").alias("content"), F.lit(True).alias("titled")))
    # Computed once: a document without chunks but with a title gives one chunk of that.
    chunks = let(cut, lambda c: F.when((F.size(c) == 0) & (F.col("meta.title") != ""), alone).otherwise(c))
    each = parsed.select("release", "path", "meta", F.posexplode(chunks).alias("nth", "c"))
    anchor = F.when(F.col("c.titled") | (F.col("c.heading") == ""), "").otherwise(slug(F.col("c.heading")))
    return each.select("path", anchor.alias("anchor"), "meta.title", "meta.breadcrumb", "c.heading", "release", "c.content", "meta.canonical_url", "meta.last_updated", "c.section", "c.window", "nth")


def embed_text() -> Column:
    """Distinct filled context parts of a chunk, an empty line, and its content."""
    parts = F.array_distinct(F.filter(F.array("breadcrumb", "title", "heading"), lambda x: x != ""))
    return F.when(F.size(parts) == 0, F.col("content")).otherwise(F.concat(F.array_join(parts, " — "), F.lit("\n\n"), F.col("content")))


def first_ids(sizes: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``sizes`` (keys, _n) with _first, the sum of _n of all rows before in the order of ``keys``, which tell rows apart; and the number of rows."""
    sizes = written(sizes, "sizes")
    many = sizes.count()
    # Written, since ranges drawn anew could differ.
    ranged = written(sizes.repartitionByRange(max(1, -(-many // RANGE)), *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # one row for each range
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("_first", F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before"), many


def with_ids(chunks: DataFrame, first: int = 1) -> DataFrame:
    """``chunks`` of chunk_docs() with id from ``first`` on in the order of (release, path, section, window).

    Chunks are written once and don't move: documents' keys and sizes alone are range-partitioned
    and added up, within partitions and then by the partitions' sums before, and each
    document's first id, of up to DOCUMENTS broadcast, meets its chunks. A document is told by
    the row of its first chunk, so documents that share release and path follow one another.
    """
    chunks = written(chunks.withColumn("_row", F.monotonically_increasing_id() - F.col("nth")), "chunks")
    starts, many = first_ids(chunks.groupBy("release", "path", "_row").agg(F.count("*").alias("_n")), ["release", "path", "_row"])
    near = F.broadcast if many <= DOCUMENTS else (lambda table: table)
    return chunks.join(near(starts.select("_row", "_first")), "_row").withColumn("id", F.col("_first") + F.col("nth") + first).drop("_row", "_first", "nth")
