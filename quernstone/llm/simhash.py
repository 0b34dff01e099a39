"""Near-duplicates by SimHash fingerprints, linked by a binary trie joined with itself.

Fingerprints: a document's text, A-Z lower-cased, is cut into words at ASCII white space;
each run of ``width`` words, joined by single spaces, is hashed with XXH64 (seed 42); a
bit of the fingerprint is set where more than half of the hashes have it set.

Links: two fingerprints that differ in at most ``budget`` bits agree on all but ``budget``
of the blocks into which the 64 bits are cut. Distinct fingerprints are dealt by each
choice of agreeing blocks, so that one group has at most 2**22 members, whatever the
data. Within a group a binary trie over the fingerprints is traversed against itself:
pairs of nodes go down together, differing bits add up, and a pair of nodes whose bits
exceed the budget is left. A group gives a spanning forest of its links, never all pairs.
Components of the links come from alternating large-star and small-star steps.

Defined cases: null and empty texts and texts of spaces have the fingerprint zero, which is
linked like any other; a text of fewer than ``width`` words is one shingle; rows that repeat
a doc_id are one node; rows without doc_id link by their fingerprints and return null for
doc_id, and null for component_id where no row with a doc_id is reached (a budget of zero
takes such rows for linked if only their lowest bit differs); doc_ids that span 2**63 or more
are an error;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import with_key, written

#: Widths of the blocks into which a fingerprint is cut, lowest bits first.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: doc_ids are counted from the least one and moved by this much, below zero; nodes from zero on stand for fingerprints that only rows without doc_id have.
MOVED = -(1 << 63)
#: Pairs of trie nodes that are open at a time.
PAIRS = 1 << 21
#: A fingerprint of more than this part of all rows is matched by broadcast.
OFTEN = 1024
#: A table of ids of so many rows at most is broadcast: 16 MB.
FEW = 1 << 20


def fingerprint_rows(buf: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each row of a text column, as unsigned 64-bit integers."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in B.slices(offsets):
        lo, hi = offsets[i], offsets[j]
        text = B.LOWER[buf[lo:hi]]
        starts, ends, first = B.words(text, offsets[i : j + 1] - lo)
        if not len(starts):
            continue
        # Words one after another with a space behind each: a shingle is one slice of it.
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(to[-1], 32, np.uint8)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        joined[place + np.repeat(to[:-1], size)] = text[place + np.repeat(starts, size)]
        counts = np.diff(first)
        shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        run = np.cumsum(shingles) - shingles
        head = np.repeat(first[:-1] - run, shingles) + np.arange(shingles.sum())
        last = head + np.repeat(np.minimum(counts, width), shingles) - 1
        data, hash64 = joined.tobytes(), xxhash.xxh64_intdigest
        hashes = np.fromiter((hash64(data[s:e], 42) for s, e in zip(to[head].tolist(), (to[last + 1] - 1).tolist())), np.uint64, len(head))
        rows = np.flatnonzero(shingles)
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            begin, end = run[part[0]], run[part[-1]] + shingles[part[-1]]
            out[i + part] = majority(hashes[begin:end], run[part] - begin, shingles[part])
    return out


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes: the bits set in more than half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row of ``docs`` as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fp = fingerprint_rows(*B.column_bytes(batch.column("text")), width)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})
        B.give_back()

    return with_key(docs).mapInArrow(run, "doc_id long, fp long")


def masks(budget: int) -> list[int]:
    """One mask for each choice of blocks on which two linked fingerprints may agree."""
    at, fields = 0, []
    for w in BLOCKS:
        fields.append(((1 << w) - 1) << at)
        at += w
    return [sum(x) for x in combinations(fields, len(BLOCKS) - budget)]


def trie_pairs(fps: np.ndarray, groups: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that differ in at most ``budget`` bits, within groups.

    fps: unsigned, sorted within groups; groups: the n+1 places where groups begin. A node
    of a group's trie is a range of places whose upper bits agree; all groups go down
    together, one bit a step. Pairs come in parts: where more than PAIRS pairs of nodes are
    open, one half waits until the other has reached the leaves.
    """
    big = np.flatnonzero(np.diff(groups) > 1)
    waiting = [(63, (groups[big], groups[big + 1], groups[big], groups[big + 1], np.zeros(len(big), np.int8)))]
    while waiting:
        bit, (a0, a1, b0, b1, off) = waiting.pop()
        if bit < 0:
            yield a0, b0
            continue
        if not len(a0):
            continue
        if len(a0) > PAIRS:
            half = len(a0) // 2
            waiting += [(bit, tuple(x[half:] for x in (a0, a1, b0, b1, off))), (bit, tuple(x[:half] for x in (a0, a1, b0, b1, off)))]
            continue
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same, far = a0 == b0, np.int8(1)
        cross = ~same
        parts = [
            (a0, am, b0, bm, off),
            (am, a1, bm, b1, off),
            (a0, am, bm, b1, off + far),
            (am[cross], a1[cross], b0[cross], bm[cross], off[cross] + far),
        ]
        a0, a1, b0, b1, off = (np.concatenate(x) for x in zip(*parts))
        keep = (off <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        waiting.append((bit - 1, (a0[keep], a1[keep], b0[keep], b1[keep], off[keep])))


def links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """(u, v): links between representatives (u > v) that span what ``classes`` (fp, rep) link within ``budget`` bits."""

    def grouped(batches):
        """Batches that end where a group ends; the rest is held for the next."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = table.column("key").to_numpy()
            choice = table.column("choice").to_numpy()
            if not len(key):
                continue
            change = np.flatnonzero((key[1:] != key[:-1]) | (choice[1:] != choice[:-1])) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for table in grouped(batches):
            key, choice, fp, rep = (table.column(c).to_numpy() for c in ("key", "choice", "fp", "rep"))
            groups = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (choice[1:] != choice[:-1])) + 1, [len(key)]])
            # Only groups of two and more go on, sorted by the fingerprint's unsigned value.
            size = np.diff(groups)
            keep = np.repeat(size > 1, size)
            if not keep.any():
                continue
            group, fp, rep = np.repeat(np.arange(len(size)), size)[keep], fp.view(np.uint64)[keep], rep[keep]
            order = np.lexsort((fp, group))
            group, fp, rep = group[order], fp[order], rep[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            nodes, place = np.unique(rep, return_inverse=True)
            label = np.arange(len(nodes))
            for i, j in trie_pairs(fp, starts, budget):
                # Pairs join the forest at once, so that never more than a part of them is held.
                label = B.components(len(nodes), np.concatenate([np.arange(len(nodes)), label[place[i]]]), np.concatenate([label, label[place[j]]]))
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            if len(moved):
                yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[moved]), "v": pa.array(nodes[label[moved]])})
        B.give_back()

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks(budget))])
    dealt = classes.select("fp", "rep", F.explode(choices).alias("c")).select("c.choice", "c.key", "fp", "rep")
    return dealt.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node of ``edges`` (u, v), itself included.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each
    round's links are written to the shared folder.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_component(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with what ``classes`` (fp, n and other columns) have of their fingerprint.

    Rows of a fingerprint that more than ``total`` / OFTEN rows share stay where they are:
    there are fewer than OFTEN such fingerprints, so they are broadcast. All others meet by
    fingerprint, none with more than that share of the rows.
    """
    often = F.broadcast(classes.where(F.col("n") * OFTEN > total).drop("n"))
    rest = classes.where(F.col("n") * OFTEN <= total).drop("n")
    return rows.join(often, "fp").unionByName(rows.join(often, "fp", "left_anti").join(rest, "fp"))


def classified(docs: DataFrame, width: int, budget: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, fp) of each row, (fp, n, component, loose) of each fingerprint, and the number of rows; component is null where no doc_id is reached, and loose tells such components apart."""
    prints = written(fingerprints(docs, width), "fingerprints")
    total, low, high = prints.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    low = low or 0
    if (high or 0) - low >= 1 << 63:
        raise ValueError("doc_ids span 2**63 or more")
    node_of = lambda c: (c - F.lit(low)) + F.lit(MOVED)
    node = F.coalesce(node_of(F.col("doc_id")), F.shiftrightunsigned("fp", 1))
    classes = written(prints.groupBy("fp").agg(F.min(node).alias("rep"), F.count("*").alias("n")), "classes")
    # Rows that repeat a doc_id hold together, whatever their fingerprints.
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    repeated = prints.join(few(several), "doc_id", "left_semi").distinct()
    same_id = with_component(repeated, classes.withColumnRenamed("rep", "component"), total).select(node_of(F.col("doc_id")).alias("u"), F.col("component").alias("v"))
    parts = connected(links(classes.select("fp", "rep"), budget).unionByName(same_id))
    classes = classes.join(parts, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("node"))
    component = F.when(F.col("node") < 0, (F.col("node") - F.lit(MOVED)) + F.lit(low))
    classes = classes.select("fp", "n", component.alias("component"), F.when(F.col("node") >= 0, F.col("node")).alias("loose"))
    return prints, written(classes, "components"), total


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``: near copies share the component's least doc_id."""
    out = with_component(*classified(docs, width, budget))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def few(table: DataFrame) -> DataFrame:
    """``table``, written, and broadcast if it has at most FEW rows."""
    table = written(table, "few")
    return F.broadcast(table) if table.count() <= FEW else table


def one_of_each(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """One row of each near-duplicate component of ``docs``.

    It is the row with the least doc_id; of rows that repeat it, and where no row has one, the
    one with the least hash of its text.
    """
    prints, classes, total = classified(docs, width, budget)
    found = written(with_component(prints, classes, total), "found")
    names, key = docs.columns, F.col("doc_id").cast("long")
    least = F.struct(F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))

    def one_row(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("_by")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), least).alias("_row")).select("_row.*")

    copies = few(found.where("doc_id <> component").select(F.col("doc_id").alias("_copy")).distinct())
    kept = docs.where("doc_id is not null").join(copies, key == copies["_copy"], "left_anti")
    several = written(found.where("doc_id = component").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_several")), "several")
    if not several.isEmpty():
        near = few(several)
        again = kept.join(near, key == near["_several"], "left_semi")
        kept = kept.join(near, key == near["_several"], "left_anti").unionByName(one_row(again, "doc_id"))
    if not found.where("doc_id is null and component is null").isEmpty():
        nameless = docs.where("doc_id is null")
        inner = nameless.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))

        def run(batches):
            for batch in batches:
                fp = fingerprint_rows(*B.column_bytes(batch.column("text")), width)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fp.view(np.int64))], ["row", "fp"])
            B.give_back()

        own = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, fp long")
        alone = with_component(own, classes.where("component is null"), total)
        alone = alone.groupBy("loose").agg(F.min_by("row", F.struct(F.xxhash64(F.col("row.text").cast("string")), F.col("row.text").cast("string"))).alias("_row")).select("_row.*")
        kept = kept.unionByName(alone)
    return kept
