"""How the sources of each language differ from one another and from the language, term by term.

Terms are maximal runs of ASCII letters and bytes from 0x80 on, A-Z lower-cased. A task looks
its documents' concatenated UTF-8 bytes up in a table of 256 entries, so that the edges of
that array are the terms' boundaries; slices are grouped by their XXH64 and compared byte by
byte with the first of their group, and what a hash alone took for equal is split. One row of
each (lang, source, term) leaves the task; Spark adds the rows up.

The terms kept for a language (in ``least`` documents or more) become rows of CSR matrices,
dealt by (lang, block of terms), with the sources as columns. From each block's cells
come the sums of the divergences of all pairs of sources and the first terms of each source;
sums and candidates of the blocks meet natively. A language with most of all rows has as
many blocks as its terms fill, and no task holds more than a block and the language's sources.

With c the count of a term in a group, N the sum over kept terms, V their number, in whole numbers

    p = 1 + floor(10^9 (c + 2) / (N + 2 V))        f(p, q) = floor((p - q)^2 / (p + q))

Part ``pair`` has f summed over all kept terms for each other source of the language; f is
symmetric, and terms that neither source has add up to their number times one value. Part
``term`` has the first ``top`` terms of each group whose p is above the language's.
Divisions go digit by digit (to base 1000), so nothing overflows below 9e15 occurrences.

Defined cases: null text, lang and source are empty; each row is a document, also where rows
repeat a doc_id; a document without terms still makes its group; a language without kept
terms has pairs of value 0 and no terms; a lone source has no pairs; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import written

#: Bytes that end a term: ASCII but letters.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SCALE = 1_000_000_000
#: Bytes of text that a task groups at a time.
CHUNK = 16 << 20
#: Cells (counts above zero) of a block of terms.
CELLS = 1 << 18
#: Cells of a block that are compared with all sources at a time, times the number of sources.
WIDE = 1 << 21
#: Up to so many languages are broadcast, with a number each.
LANGS = 1 << 16


def lanes(buf: np.ndarray, starts: np.ndarray, k: int, ends: np.ndarray) -> np.ndarray:
    """Bytes 8k to 8k+7 of each slice as a number, zeros behind its end. buf: with 8 spare bytes at its end."""
    at = starts + 8 * k
    found = np.lib.stride_tricks.sliding_window_view(buf, 8)[at].view("<u8").ravel()
    spare = np.clip(at + 8 - ends, 0, 8).astype(np.uint64)
    # A shift by all 64 bits isn't defined, so the mask is made in two.
    return found & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (spare * np.uint64(4)) >> (spare * np.uint64(4)))


def grouped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hash64=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): the first slice of each group of equal slices, and the group of each slice. buf: with 8 spare bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 17):
        s, e = starts[i : i + (1 << 17)], ends[i : i + (1 << 17)]
        data, lo = buf[s[0] : e[-1]].tobytes(), s[0]
        hashes[i : i + len(s)] = np.fromiter((hash64(data[a:b]) for a, b in zip((s - lo).tolist(), (e - lo).tolist())), np.uint64, len(s))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    # Every slice against the first of its group, eight bytes at a time.
    head, size = first[number], ends - starts
    wrong, todo = size != size[head], np.flatnonzero(size == size[head])
    k = 0
    while len(todo):
        h = head[todo]
        wrong[todo] |= lanes(buf, starts[todo], k, ends[todo]) != lanes(buf, starts[h], k, ends[h])
        k += 1
        todo = todo[size[todo] > 8 * k]
    if wrong.any():
        seen: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong).tolist():
            term = buf[starts[i] : ends[i]].tobytes()
            if term not in seen:
                seen[term] = len(first) + len(more)
                more.append(i)
            number[i] = seen[term]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return first, number


def texts_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow string array."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def counted(rows: pa.Table, hash64=xxhash.xxh64_intdigest) -> pa.Table:
    """(lang, source, term, n, docs) of documents (lang, source, text): occurrences and documents by group and term."""
    key = pc.binary_join_element_wise(pc.cast(pc.binary_length(rows.column("lang")), pa.string()), rows.column("lang"), rows.column("source"), ":")
    group = pc.dictionary_encode(key.combine_chunks()).indices.to_numpy()
    # Documents of a group stand side by side, so that one sort by (term, document) has groups in a row too.
    order = np.argsort(group, kind="stable")
    group, rows = group[order], rows.take(pa.array(order))
    one = np.flatnonzero(np.diff(group, prepend=-1))
    of_group = rows.select(["lang", "source"]).take(pa.array(one))
    group = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    buf, offsets = B.column_bytes(rows.column("text"))
    buf = np.concatenate([B.LOWER[buf], np.zeros(8, np.uint8)])
    starts, ends, first = B.words(buf[:-8], offsets, BREAKS)
    head, number = grouped(buf, starts, ends, hash64)
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    placed = np.sort(number * len(rows) + doc)
    fresh = np.flatnonzero(np.diff(placed, prepend=-1))
    times = np.diff(np.append(fresh, len(placed)))
    term, at = placed[fresh] // max(len(rows), 1), group[placed[fresh] % max(len(rows), 1)] if len(rows) else fresh
    edge = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
    if not len(edge):
        return COUNTED.empty_table()
    n, docs = np.add.reduceat(times, edge), np.diff(np.append(edge, len(term)))
    h = head[term[edge]]
    own = of_group.take(pa.array(at[edge]))
    return pa.table([own.column("lang"), own.column("source"), texts_of(buf, starts[h], ends[h]), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTED)


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counts(docs: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """(lang, term, cells): the terms in ``least`` documents of the language or more; cells: array of (source, n)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            at = B.column_bytes(batch.column("text"))[1]
            for i, j in B.slices(at, chunk // 4):
                held.append(batch.slice(i, j - i))
                size += int(at[j] - at[i])
                if size >= chunk:
                    yield from counted(pa.Table.from_batches(held)).to_batches(1 << 16)
                    held, size = [], 0
        if held:
            yield from counted(pa.Table.from_batches(held)).to_batches(1 << 16)
        B.give_back()

    each = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    cells = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A list has a cell for each source of the language at most.
    rows = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return rows.where(F.col("docs") >= least).select("lang", "term", "cells")


def share(c: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE (c + 2) / (n + 2 v)), exactly."""
    under = n + 2 * v
    whole, rest = np.divmod(c + 2, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + digit
    return 1 + whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Block:
    """A CSR matrix of counts: terms are rows, sources are columns; p holds what share() makes of the cells."""

    def __init__(self, terms: pa.Array, indptr: np.ndarray, column: np.ndarray, n: np.ndarray, totals: np.ndarray, lang_total: int, kept: int):
        self.terms, self.indptr, self.column, self.width = terms, indptr, column, len(totals)
        self.row = np.repeat(np.arange(len(terms)), np.diff(indptr))
        self.zero = share(np.zeros(self.width, np.int64), totals, kept) if kept else np.ones(self.width, np.int64)
        self.p = share(n, totals[column], kept) if kept else n[:0]
        of_term = np.add.reduceat(n, indptr[:-1]) if len(terms) else n[:0]
        self.q = share(of_term, np.array(lang_total), kept) if kept else n[:0]

    def pairs(self) -> np.ndarray:
        """f of all pairs of sources, summed over the block's terms."""
        w = self.width
        one, both, of_both = np.zeros((w, w), np.int64), np.zeros((w, w), np.int64), np.zeros((w, w), np.int64)
        order = np.argsort(self.column, kind="stable")
        step = max(1, WIDE // max(w, 1))
        for a in range(0, len(order), step):
            cells = order[a : a + step]
            rows, back = np.unique(self.row[cells], return_inverse=True)
            wide, there = np.repeat(self.zero[None, :], len(rows), 0), np.zeros((len(rows), w), bool)
            size = np.diff(self.indptr)[rows]
            own = np.repeat(self.indptr[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at = np.repeat(np.arange(len(rows)), size)
            wide[at, self.column[own]], there[at, self.column[own]] = self.p[own], True
            f, there = apart(self.p[cells][:, None], wide[back]), there[back]
            column = self.column[cells]
            edge = np.flatnonzero(np.diff(column, prepend=-1))
            one[column[edge]] += np.add.reduceat(f, edge, axis=0)
            of_both[column[edge]] += np.add.reduceat(f * there, edge, axis=0)
            both[column[edge]] += np.add.reduceat(there.astype(np.int64), edge, axis=0)
        n = np.diagonal(both)
        neither = len(self.terms) - n[:, None] - n[None, :] + both
        return one + one.T - of_both + neither * apart(self.zero[:, None], self.zero[None, :])

    def first_terms(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, row, f) of each source's first terms."""
        q = self.q[self.row]
        some = np.flatnonzero(self.p > q)
        f = apart(self.p[some], q[some])
        rank = np.empty(len(self.terms), np.int64)
        rank[pc.sort_indices(self.terms.cast(pa.binary())).to_numpy()] = np.arange(len(self.terms))
        order = np.lexsort((rank[self.row[some]], -f, self.column[some]))
        some, f = some[order], f[order]
        column = self.column[some]
        edge = np.flatnonzero(np.diff(column, prepend=-1))
        nth = np.arange(len(some)) - np.repeat(edge, np.diff(np.append(edge, len(some))))
        few = nth < top
        return column[few], self.row[some[few]], f[few]


RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def compared(left: pa.Table, right: pa.Table, top: int) -> pa.Table:
    """One block's sums and candidates. left: (term, cells); right: (lang, source, total, lang_total, kept) of all sources of the language."""
    right = right.sort_by("source")
    sources = right.column("source").combine_chunks()
    lang, totals = right.column("lang")[0].as_py(), right.column("total").to_numpy()
    cells = left.column("cells").combine_chunks()
    flat = cells.flatten()
    block = Block(
        left.column("term").combine_chunks(), np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())]).astype(np.int64),
        pc.index_in(flat.field("source"), sources).to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64),
        totals, right.column("lang_total")[0].as_py(), right.column("kept")[0].as_py(),
    )
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    column, row, f = block.first_terms(top)
    pair = [sources.take(pa.array(a)), pa.array(["pair"] * len(a), pa.string()), sources.take(pa.array(b)), pa.array(block.pairs()[a, b], pa.int64())]
    term = [sources.take(pa.array(column)), pa.array(["term"] * len(column), pa.string()), block.terms.take(pa.array(row)), pa.array(f, pa.int64())]
    tables = [pa.table([pa.array([lang] * len(x[1]), pa.string()), *x], schema=RESULT) for x in (pair, term)]
    return pa.concat_tables(tables)


def divergence(docs: DataFrame, least: int = 10, top: int = 10, chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module's description."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(counts(named, least, chunk), "divergence-counts")
    each = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"), F.count("*").alias("filled"))
    groups = named.groupBy("lang", "source").agg(F.count("*").alias("_"))  # text isn't read
    totals = groups.join(each, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("filled", F.lit(0).cast("long")).alias("filled"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    over = Window.partitionBy("lang")  # one row for each source
    totals = totals.withColumn("lang_total", F.sum("total").over(over)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.sum("filled").over(over) / cells)).cast("long"))
    totals = written(totals.join(terms, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))), "divergence-totals")
    blocks = totals.select("lang", "blocks").distinct()
    # One row for each language: few enough are broadcast, so that a language's terms stay spread.
    near = F.broadcast if blocks.count() <= LANGS else (lambda table: table)
    dealt = kept.join(near(blocks), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    sources = totals.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = dealt.select("lang", "block", "term", "cells").groupBy("lang", "block")
    right = sources.select("lang", "block", "source", "total", "lang_total", "kept").groupBy("lang", "block")
    found = left.cogroup(right).applyInArrow(lambda a, b: compared(a, b, top), "lang string, source string, part string, item string, value long")
    rows = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", nth).where((F.col("part") == "pair") | (F.col("rank") <= top))
