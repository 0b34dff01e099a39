"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``width`` consecutive words of an item (all of them, if it has fewer); a
document is hit where a window occurs in it word for word. As a join of sets, a window is
the set of its shingles (SHINGLE words each; a shorter window is one shingle), ordered by
rarity: their counts over all documents. As all of them must be contained, the prefix that
any match must share is one shingle, the rarest. Documents' shingles join these tokens;
the token's place in its window gives the place where the window would begin, which must
lie within the document (positional and length bounds); what is left is verified word for
word over the item-sized window.

A document's words stay one array next to the exploded place, so the check reads the words
around a match in place: one pass over the documents, no shuffle of words or texts. The
windows are broadcast in parts of at most ``part`` windows; a larger benchmark takes one
pass for each part. Shingles are compared as hashes of words in full lower case, to find
candidates; windows are verified on the words themselves, with A-Z alone lower-cased.

Defined cases: null and empty texts have no words and no hits; items without words or
item_id are left out; windows that several items share count for each; rows that repeat
doc_id and text give a row each; other columns are ignored; an empty table gives an empty
result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART = 1_000_000
#: Words of a shingle.
SHINGLE = 5
#: Stands for the place behind a document's last word.
END = 0


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, body, size, words): the distinct windows of each item, as space-joined text and as words; several items may share one."""
    worded = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), word_array(ascii_lower(F.col("text").cast("string"))).alias("w")).where(F.size("w") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = worded.select("item_id", "w", F.explode(first).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("body"), F.size("words").alias("size"), "words").dropDuplicates(["item_id", "body"])


def shingle(words: Column, at: Column, size: Column) -> Column:
    """A hash of the shingle of ``size`` words (SHINGLE at most) at place ``at``; it may be that of other words too."""
    return F.xxhash64(size, *[F.when(size > i, F.get(words, at + i)) for i in range(SHINGLE)])


def tokens(docs: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """``found``, distinct windows (body, size, words), with their rarest shingle (token) and its place in the window (ahead). docs: (doc_id, low)."""
    size = F.least(F.col("size"), F.lit(SHINGLE))
    low = F.transform("words", F.lower)
    spread = found.select("body", "size", low.alias("low"), F.explode(F.sequence(F.lit(0), F.col("size") - size)).alias("ahead"))
    spread = spread.select("body", "size", "ahead", shingle(F.col("low"), F.col("ahead"), size).alias("token"))
    vocabulary = spread.select("token").distinct()
    small = vocabulary.count() <= PART
    near = F.broadcast if small else (lambda table: table)
    counts = doc_tokens(docs, lengths).join(near(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = spread.join(near(counts), "token", "left")
    order = Window.partitionBy("body").orderBy(F.coalesce("n", F.lit(0)), "token", "ahead")
    return ranked.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("body", "size", "token", "ahead")


def doc_tokens(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` (with low, its words in lower case) with a row for each shingle of ``lengths`` words: pos and token, and one for the end."""
    n = F.size("low")
    placed = docs.select("*", n.alias("n_words"), F.explode(F.sequence(F.lit(0), n)).alias("pos"))
    each = [F.when(F.col("pos") + k <= F.col("n_words"), shingle(F.col("low"), F.col("pos"), F.lit(k))) for k in lengths]
    last = F.col("pos") == F.col("n_words")
    if len(lengths) == 1:
        return placed.withColumn("token", F.when(last, F.lit(END).cast("long")).otherwise(each[0]))
    return placed.withColumn("token", F.explode(F.when(last, F.array(F.lit(END).cast("long"))).otherwise(F.array(*each))))


def hits(docs: DataFrame, items: DataFrame, width: int = 10, part: int = PART) -> DataFrame:
    """(doc_id, tag, n_words, copies, found, items): a row for each distinct document; found: (at, size) of each place of a window, items: whose windows those are.

    Windows meet documents once, whatever number of items shares them; a document's distinct
    windows then meet their items.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of_items = written(windows(items, width), "windows")
    found = written(of_items.select("body", "size", "words").distinct(), "distinct-windows")
    # Full lower case neither makes nor removes what stands between words.
    low = word_array(F.lower("text")).alias("low")
    # At most SHINGLE numbers.
    lengths = sorted(r[0] for r in found.select(F.least(F.col("size"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    keyed = tokens(texts.select("doc_id", low), found, lengths)
    parts = max(1, -(-found.count() // part))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(parts)))
    spread = doc_tokens(texts.select("doc_id", F.xxhash64("text").alias("tag"), word_array(F.col("text")).alias("words"), low), lengths)
    none = F.lit(None).cast("string")
    end = docs.sparkSession.range(1).select(none.alias("body"), F.lit(0).alias("size"), F.lit(END).cast("long").alias("token"), F.lit(0).alias("ahead"))
    out = None
    for k in range(parts):
        some = keyed.where(F.col("part") == k).drop("part")
        some = some.unionByName(end) if k == 0 else some
        at = F.col("pos") - F.col("ahead")
        inside = (F.col("pos") < F.col("n_words")) & (at >= 0) & (at + F.col("size") <= F.col("n_words"))
        same = ascii_lower(F.array_join(F.slice("words", at + 1, F.col("size")), " ")) == F.col("body")
        kept = F.when(F.col("body").isNull(), F.col("pos") == F.col("n_words")).otherwise(inside & same)
        # The right side has at most ``part`` windows.
        joined = spread.join(F.broadcast(some), (spread["token"] == some["token"]) & kept)
        joined = joined.select("doc_id", "tag", "n_words", "body", at.alias("at"), "size")
        out = joined if out is None else out.unionByName(joined)
    # The ends of documents have no window; they meet none of the items and keep their documents.
    each = out.groupBy("doc_id", "tag", "n_words", "body").agg(F.count_if(F.col("body").isNull()).alias("copies"), F.collect_set(F.when(F.col("body").isNotNull(), F.struct("at", "size"))).alias("places"))
    named = of_items.groupBy("body").agg(F.collect_list("item_id").alias("ids"))
    near = F.broadcast if of_items.count() <= part else (lambda table: table)
    each = each.join(near(named), "body", "left")
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast(each.schema[c].dataType))))
    return each.groupBy("doc_id", "tag", "n_words").agg(F.sum("copies").alias("copies"), flat("places").alias("found"), F.array_sort(F.array_distinct(flat("ids"))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    each = hits(docs, items, width).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    places = F.flatten(F.transform("found", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
    return each.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("found") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs."""
    dirty = written(hits(docs, items, width).where(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")), "dirty")
    # Few enough are broadcast, so that texts aren't shuffled.
    near = F.broadcast(dirty) if dirty.count() <= PART else dirty
    match = docs["doc_id"].cast("long").eqNullSafe(near["_id"]) & (F.xxhash64(docs["text"].cast("string")) == near["_tag"])
    return docs.join(near, match, "left_anti")
