"""Removal of repeated passages by longest-previous-factor arrays over dealt-out suffixes.

A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a
document with a smaller doc_id, or earlier in the same one. In terms of suffixes: position
i begins such a string where the longest previous factor LPF[i] is at least ``length``.
The array follows from suffix order: LPF[i] is the longer of the common prefixes with the
nearest suffixes before and after it that start earlier in the text (previous and next
smaller positions). Comparisons are bounded at ``length`` bytes, ties are ordered by
position.

Suffixes are dealt out so that equal strings meet: the string at position i belongs to its
minimizer, the 32-byte gram in it with the least hash, whose place depends on the string
alone. Positions with one minimizer form an occurrence, a stretch of text sent as one. An
array over the strings that met has LPF >= ``length`` just where the whole corpus's has.
Three exchanges, keyed by hashes and answered by block:

1. minimizers that occur once in the corpus drop out (their strings can't repeat);
2. occurrences of the others meet: of whole equal occurrences, compared byte by byte, the
   first goes on, and LPF arrays decide where different occurrences share a minimizer;
3. removed ranges return to their blocks and the documents are cut.

Before the second exchange each block drops its own equal occurrences, so a passage that
a third of all documents share is sent once by each block. Occurrences of a minimizer that
occurs more than ``hot`` times first meet among GROUP blocks at most, which send on one of
each, string by string, dealt by the strings' own hashes.

Defined cases: null and empty texts have no bytes and no spans; rows without doc_id come
before all others; rows that repeat doc_id and text are one document and get the same
result; rows that repeat a doc_id with other texts are ordered by a hash of the text.
Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import blocks, bucket_count, dealt, pack, read_block, unpack, with_key, written

GRAM = 32
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 5 << 20
#: Occurrences of a minimizer that occurs more often than this meet among GROUP blocks first and go on string by string.
HOT = 1 << 14
GROUP = 512
#: Text that one suffix sort holds at most, but for a single minimizer's occurrences (HOT of them at most).
SORT_BYTES = 1 << 20
LOWEST = np.iinfo(np.int64).min


def minimizers(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last) of each occurrence: its gram's hash and place, and the positions whose strings it covers."""
    n, span = len(buf), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    at = np.arange(n - GRAM + 1)
    gram = B.span_hashes(buf, at, at + GRAM)
    low = (gram & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64) if n < 1 << 24 else None
    if low is None:
        return tuple(np.concatenate(x) for x in zip(*(shift(minimizers(buf[a : a + (1 << 23) + length - 1], np.clip(offsets - a, 0, min(n - a, (1 << 23) + length - 1)), length), a) for a in range(0, n - length + 1, 1 << 23))))
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    # Strings that cross the end of a document don't count.
    room = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    long_ = np.flatnonzero(size >= length)
    np.add.at(room, offsets[long_], 1)
    np.add.at(room, offsets[long_ + 1] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(room[: n - length + 1]) > 0)
    if not len(valid):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    place = place[valid]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    last = valid[np.concatenate([new[1:] - 1, [len(valid) - 1]])]
    return gram[place[new]], place[new], valid[new], last


def shift(found: tuple, by: int) -> tuple:
    return (found[0], *(x + by for x in found[1:]))


def block_occurrences(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """minimizers() of all rows of a block, slice by slice."""
    parts = [shift(minimizers(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length), offsets[i]) for i, j in B.slices(offsets)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def bounded_lpf(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each string of ``length`` bytes, no more than ``length``.

    text: stretches one behind the other; the stretch that starts at starts[k] holds
    counts[k] strings, and strings with a smaller rank[k] + offset start earlier; ranks of
    stretches that overlap in one document differ by their distance. Strings are sorted by
    prefix doubling; the common prefixes of neighbours in that order follow from the ranks
    of each doubling; the previous and the next smaller position in that order give the
    candidates for the longest earlier match.
    """
    n, many = len(text), int(counts.sum())
    if not many:
        return np.zeros(0, np.int64)
    lanes = np.zeros(n + 8, np.uint64)
    lanes[:n] = text
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | lanes[k : k + n]
    del lanes
    ranks, depth = [(8, np.unique(word, return_inverse=True)[1].astype(np.uint32))], 8
    begin = np.repeat(starts, counts) + np.arange(many) - np.repeat(np.cumsum(counts) - counts, counts)
    while depth < length:
        step, last = min(depth, length - depth), ranks[-1][1]
        pair = last.astype(np.uint64) << np.uint64(32)
        pair[: n - step] |= last[step:]
        depth += step
        ranks.append((depth, np.unique(pair, return_inverse=True)[1].astype(np.uint32)))
        del pair
    place = np.repeat(rank, counts) + (begin - np.repeat(starts, counts))
    order = np.lexsort((place, ranks[-1][1][begin]))
    at, place = begin[order], place[order]
    common = np.zeros(many, np.int64)
    common[1:] = common_prefixes(at[:-1], at[1:], word, ranks, length)
    before = nearest_smaller(place, common)
    after = nearest_smaller(place[::-1], np.concatenate([[0], common[1:][::-1]]))[::-1]
    out = np.zeros(many, np.int64)
    out[order] = np.maximum(before, after)
    return out


def common_prefixes(a: np.ndarray, b: np.ndarray, word: np.ndarray, ranks: list[tuple[int, np.ndarray]], length: int) -> np.ndarray:
    """The length of the common prefix of the strings at ``a`` and ``b``, no more than ``length``. word: the eight bytes at each place, as a number."""
    out = np.where(ranks[-1][1][a] == ranks[-1][1][b], length, 0)
    rest = np.flatnonzero(out < length)
    x, y, size = a[rest], b[rest], np.zeros(len(rest), np.int64)
    for depth, ids in ranks[-2::-1]:
        size += depth * (ids[np.minimum(x + size, len(ids) - 1)] == ids[np.minimum(y + size, len(ids) - 1)])
    # The first byte that differs is one of the next eight.
    differs = word[np.minimum(x + size, len(word) - 1)] ^ word[np.minimum(y + size, len(word) - 1)]
    for k in range(1, 8):
        size += differs < np.uint64(1 << (8 * k))
    out[rest] = np.minimum(size, length)
    return out


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The common prefix of each string with the nearest before it that has a smaller place, 0 if there is none.

    common[i]: the common prefix of strings i - 1 and i. All pointers start at the neighbour
    and jump along each other's until they reach a smaller place or share no byte.
    """
    to, least = np.arange(len(place)) - 1, common.copy()
    least[:1] = 0
    todo = np.flatnonzero((least > 0) & (place[to] >= place))
    while len(todo):
        via = to[todo]
        jump, share = to[via], np.minimum(least[todo], least[via])
        to[todo], least[todo] = jump, share
        todo = todo[(share > 0) & (place[jump] >= place[todo])]
    return least


def take(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of buf, one behind the other."""
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(to[-1], np.uint8)
    for a in range(0, len(sizes), 4096):
        b = min(a + 4096, len(sizes))
        out[to[a] : to[b]] = buf[np.arange(to[b] - to[a]) + np.repeat(starts[a:b] - (to[a:b] - to[a]), sizes[a:b])]
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches of buf at ``a`` and ``b`` hold the same bytes."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 4096):
        size = sizes[i : i + 4096]
        head = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(head, size)
        differ = buf[inner + np.repeat(a[i : i + 4096], size)] != buf[inner + np.repeat(b[i : i + 4096], size)]
        out[i : i + 4096] = ~np.logical_or.reduceat(differ, head)
    return out


def first_of_equals(key, lead, buf, starts, sizes, order_by) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keeps, later, first): which occurrences stand first among equal ones, which are equal to one that starts earlier, and each one's first.

    Hashes bring equal occurrences together; each is then compared with its first byte by byte.
    """
    ends = starts + sizes
    hashed = B.mix(B.hashes_by_parts(buf, starts, ends) ^ lead.astype(np.uint64))
    order = np.lexsort((*order_by[::-1], hashed, key))
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    same = np.flatnonzero(~first)
    a, b = order[same], head[same]
    alike = (sizes[a] == sizes[b]) & (lead[a] == lead[b])
    alike[alike] = same_bytes(buf, starts[a[alike]], starts[b[alike]], sizes[a[alike]])
    other = same[~alike]
    first[other], head[other] = True, order[other]
    keeps, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    keeps[order] = first
    differs = np.zeros(len(order), bool)
    for x in order_by:
        differs |= x[order] != x[head]
    later[order] = ~first & differs
    first_of = np.zeros(len(order), np.int64)
    first_of[order] = head
    return keeps, later, first_of


def first_rows(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """For each row the first that has its id and tag."""
    order = np.lexsort((tags, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])
    out = np.zeros(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    return out


def removed_spans(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, text, spans) for each row of ``docs``: spans lists the maximal removed byte ranges [start, end) of the text."""
    return _removed(with_key(docs), length, hot, spans_of, "doc_id long, text string, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    return _removed(with_key(docs), length, hot, digest_of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _removed(docs: DataFrame, length: int, hot: int, result, schema: str) -> DataFrame:
    """``result`` of each block's rows, bytes, row places, and removed ranges with the n+1 places where rows' ranges begin."""
    length = max(length, GRAM)
    table = blocks(docs, "repeat-blocks", BLOCK_BYTES)
    n, many = bucket_count(table, BUCKET_BYTES), table.count()
    groups = max(1, -(-many // GROUP))
    request = "bucket long, block_id long, body binary"

    def opened(folder, path):
        rows = read_block(folder, path)
        buf, offsets = B.column_bytes(rows.column("text"))
        return rows, buf, offsets

    def names(rows, buf, offsets):
        """The doc_id and the hash of the text of each row."""
        return rows.column("doc_id").fill_null(LOWEST).to_numpy(), B.span_hashes(buf, offsets[:-1], offsets[1:]).view(np.int64)

    def messages(bucket_of, block_id, columns):
        """One request for each bucket that gets rows of ``columns``; text goes as sizes and bytes."""
        order = np.argsort(bucket_of, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket_of[order])) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = order[a:b]
            yield int(bucket_of[part[0]]), block_id, pack(columns(part))

    def as_batch(rows):
        rows = list(rows)
        return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("bucket", pa.int64()), ("block_id", pa.int64()), ("body", pa.binary())))})

    def distinct_keys(buf, offsets):
        key = block_occurrences(buf, offsets, length)[0]
        return (*np.unique(key, return_inverse=True, return_counts=True), key)

    def ask_keys(batches):
        for batch in batches:
            for block_id, *place in zip(*(batch.column(c).to_pylist() for c in ("block_id", "folder", "path"))):
                _, buf, offsets = opened(*place)
                keys, _, counts, _ = distinct_keys(buf, offsets)
                yield as_batch(messages((keys % np.uint64(n)).astype(np.int64), block_id, lambda part: pa.table({"key": keys[part], "count": counts[part]})))
            B.give_back()

    def answer_keys(group: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in group.column("body").to_pylist()]
        keys = np.concatenate([t.column("key").to_numpy() for t in asked])
        counts = np.concatenate([t.column("count").to_numpy() for t in asked])
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        cuts = np.cumsum([0, *(t.num_rows for t in asked)])
        bodies = [np.packbits(total[a:b] > 1).tobytes() + np.packbits(total[a:b] > hot).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        del asked, keys, counts, inverse, total
        B.give_back()
        return pa.table({"bucket": group.column("bucket"), "block_id": group.column("block_id"), "body": pa.array(bodies, pa.binary())})

    def ask_text(left: pa.Table, right: pa.Table) -> pa.Table:
        block_id = left.column("block_id")[0].as_py()
        rows, buf, offsets = opened(left.column("folder")[0].as_py(), left.column("path")[0].as_py())
        key, place, first, last = block_occurrences(buf, offsets, length)
        keys, inverse = np.unique(key, return_inverse=True)
        bucket_of = (keys % np.uint64(n)).astype(np.int64)
        repeats, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        order = np.argsort(bucket_of, kind="stable")
        cuts = np.searchsorted(bucket_of[order], np.arange(n + 1))
        for b, body in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()):
            part = order[cuts[b] : cuts[b + 1]]
            half = np.frombuffer(body, np.uint8).reshape(2, -1)
            repeats[part], often[part] = (np.unpackbits(x, count=len(part)).astype(bool) for x in half)
        on = np.flatnonzero(repeats[inverse])
        hot_ = often[inverse][on]
        key, place, first, last = (x[on] for x in (key, place, first, last))
        doc = np.searchsorted(offsets, first, "right") - 1
        ids, tags = names(rows, buf, offsets)
        # Of rows that repeat doc_id and text the first is asked for; the others get its ranges.
        own = first_rows(ids, tags)[doc] == doc
        key, place, first, last, doc, hot_ = (x[own] for x in (key, place, first, last, doc, hot_))
        at, size = first - offsets[doc], last - first + length
        keeps, later, _ = first_of_equals(key, place - first, buf, first, size, (ids[doc], tags[doc], at))
        # What this block already knows goes to any bucket, to come back with the answers.
        known = np.flatnonzero(later)
        sent = np.flatnonzero(keeps)

        def columns(part):
            part = sent[part]
            return pa.table({"key": key[part], "lead": (place - first)[part].astype(np.uint16), "size": size[part].astype(np.uint32), "id": ids[doc[part]], "tag": tags[doc[part]], "at": at[part].astype(np.uint32), "doc": doc[part].astype(np.uint32), "text": pa.array([None] * len(part), pa.binary()) if not len(part) else text_column(take(buf, first[part], size[part]), size[part])})

        to = (key[sent] % np.uint64(n)).astype(np.int64)
        mine = int(B.mix(np.array([block_id], np.uint64))[0] % np.uint64(groups))
        out = list(messages(np.where(hot_[sent], -1 - (to * groups + mine), to), block_id, columns))
        if len(known):
            out.append((block_id % n, block_id, b"known" + pack(pa.table({"doc": doc[known].astype(np.uint32), "start": at[known].astype(np.uint32), "end": (at + size)[known].astype(np.uint32)}))))
        B.give_back()
        return pa.Table.from_batches([as_batch(out)])

    def send_on(asked) -> list[tuple[int, int, bytes]]:
        """Answers for occurrences that are equal to an earlier one of these blocks, and the strings of the others, for the buckets of their hashes."""
        every = pa.concat_tables([t for *_, t in asked])
        c = {k: every.column(k).to_numpy() for k in ("key", "lead", "size", "id", "tag", "at", "doc")}
        buf, offsets = B.column_bytes(every.column("text"))
        size, at = c["size"].astype(np.int64), c["at"].astype(np.int64)
        keeps, later, first_of = first_of_equals(c["key"], c["lead"].astype(np.int64), buf, offsets[:-1], size, (c["id"], c["tag"], at))
        # Rows of other blocks that repeat a document stand where their first does and go on with it.
        out, cuts = [], np.cumsum([0, *(t.num_rows for *_, t in asked)])
        for (_, block_id, _), a, b in zip(asked, cuts[:-1], cuts[1:]):
            known, on = a + np.flatnonzero(later[a:b]), a + np.flatnonzero(~later[a:b])
            if len(known):
                out.append((0, block_id, b"known" + pack(pa.table({"doc": c["doc"][known], "start": at[known].astype(np.uint32), "end": (at + size)[known].astype(np.uint32)}))))
            strings = size[on] - length + 1
            row, step = np.repeat(on, strings), np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
            start = offsets[row] + step
            key = B.hashes_by_parts(buf, start, start + length)

            def columns(part, row=row, step=step, start=start, key=key):
                r = row[part]
                sizes = np.full(len(part), length)
                return pa.table({"key": key[part], "lead": np.zeros(len(part), np.uint16), "size": sizes.astype(np.uint32), "id": c["id"][r], "tag": c["tag"][r], "at": (at[r] + step[part]).astype(np.uint32), "doc": c["doc"][r], "text": text_column(take(buf, start[part], sizes), sizes)})

            out += [(k, i, b"string" + body) for k, i, body in messages((key % np.uint64(n)).astype(np.int64), block_id, columns)]
        return out

    def answer_text(group: pa.Table) -> pa.Table:
        buckets, ids_, bodies = (group.column(c).to_pylist() for c in ("bucket", "block_id", "body"))
        out = [(b, i, x) for b, i, x in zip(buckets, ids_, bodies) if x[:5] == b"known"]
        asked = [(b, i, unpack(x.removeprefix(b"string"))) for b, i, x in zip(buckets, ids_, bodies) if x[:5] != b"known"]
        if asked and asked[0][0] < 0:
            out += send_on(asked)
        elif asked:
            every = pa.concat_tables([t for *_, t in asked])
            key, lead, size, doc_id, tag, at = (every.column(c).to_numpy().astype(t) for c, t in (("key", "u8"), ("lead", "i8"), ("size", "i8"), ("id", "i8"), ("tag", "i8"), ("at", "i8")))
            buf, offsets = B.column_bytes(every.column("text"))
            starts, owner = offsets[:-1], np.repeat(np.arange(len(asked)), [t.num_rows for *_, t in asked])
            keeps, later, first_of = first_of_equals(key, lead, buf, starts, size, (doc_id, tag, at))
            row, lo, hi = [np.flatnonzero(later)], [np.zeros(later.sum(), np.int64)], [size[later]]
            # Different occurrences of one minimizer: suffix order decides string by string.
            left = np.flatnonzero(keeps)
            _, inverse, counts = np.unique(key[left], return_inverse=True, return_counts=True)
            left = left[counts[inverse] > 1]
            left = left[np.argsort(key[left], kind="stable")]
            rank = text_order(doc_id[left], tag[left], at[left])
            groups = np.concatenate([[0], np.flatnonzero(np.diff(key[left].view(np.int64))) + 1, [len(left)]]) if len(left) else np.zeros(1, np.int64)
            sums = np.concatenate([[0], np.cumsum(size[left])])
            for g, h in B.slices(sums[groups], SORT_BYTES):
                some = left[groups[g] : groups[h]]
                k, a, b = string_runs(take(buf, starts[some], size[some]), size[some], rank[groups[g] : groups[h]], length)
                row.append(some[k])
                lo.append(a)
                hi.append(b)
            row, lo, hi = (np.concatenate(x) for x in (row, lo, hi))
            # Repeated rows from other blocks, which start where their first does, get its ranges.
            twins = np.flatnonzero(~keeps & ~later)
            twins = twins[np.argsort(first_of[twins], kind="stable")]
            a, b = (np.searchsorted(first_of[twins], row, side) for side in ("left", "right"))
            more = np.repeat(np.arange(len(row)), b - a)
            twin = twins[np.arange(len(more)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
            row, lo, hi = np.concatenate([row, twin]), np.concatenate([lo, lo[more]]), np.concatenate([hi, hi[more]])
            docs_, base = every.column("doc").to_numpy().astype("i8")[row], at[row]
            for k, (b, i, _) in enumerate(asked):
                mine = owner[row] == k
                if mine.any():
                    out.append((b, i, b"known" + pack(pa.table({"doc": docs_[mine].astype(np.uint32), "start": (base + lo)[mine].astype(np.uint32), "end": (base + hi)[mine].astype(np.uint32)}))))
        B.give_back()
        return pa.Table.from_batches([as_batch(out)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, buf, offsets = opened(left.column("folder")[0].as_py(), left.column("path")[0].as_py())
        level = np.zeros(len(buf) + 1, np.int32)
        for body in right.column("body").to_pylist():
            t = unpack(body.removeprefix(b"known"))
            base = offsets[t.column("doc").to_numpy()]
            np.add.at(level, base + t.column("start").to_numpy(), 1)
            np.add.at(level, base + t.column("end").to_numpy(), -1)
        gone = np.cumsum(level[:-1]) > 0
        first_row = first_rows(*names(rows, buf, offsets))
        for k in np.flatnonzero(first_row != np.arange(len(first_row))).tolist():
            gone[offsets[k] : offsets[k + 1]] = gone[offsets[first_row[k]] : offsets[first_row[k] + 1]]
        starts, ends, first = B.words(gone.view(np.uint8), offsets, np.array([True] + [False] * 255))
        out = result(rows, buf, offsets, starts, ends, first)
        B.give_back()
        return out

    keyed = dealt(table.select("block_id", "folder", "path"), "block_id", many, 4)
    of_block = lambda answers: keyed.groupBy("block_id").cogroup(dealt(answers, "block_id", many, 4).groupBy("block_id"))
    in_bucket = lambda asked: dealt(asked, "bucket", n, 3).groupBy("bucket")
    flags = in_bucket(keyed.mapInArrow(ask_keys, request)).applyInArrow(answer_keys, request)
    texts = of_block(flags).applyInArrow(ask_text, request)
    found = written(in_bucket(texts).applyInArrow(answer_text, request), "repeat-answers")
    strings = F.substring("body", 1, 6) == F.lit(b"string")
    found = found.where(~strings).unionByName(in_bucket(found.where(strings)).applyInArrow(answer_text, request))
    return of_block(found).applyInArrow(cut, schema)


def spans_of(rows, buf, offsets, starts, ends, first) -> pa.Table:
    base = np.repeat(offsets[:-1], np.diff(first))
    spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int64)), pa.array((ends - base).astype(np.int64))], ["start", "end"])
    return pa.table({"doc_id": rows.column("doc_id"), "text": rows.column("text"), "spans": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans)})


def digest_of(rows, buf, offsets, starts, ends, first) -> pa.Table:
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    data, sha = memoryview(np.ascontiguousarray(buf)), []
    s, e = starts.tolist(), ends.tolist()
    for k in range(len(offsets) - 1):
        at, h = int(offsets[k]), hashlib.sha256()
        for i in range(first[k], first[k + 1]):
            h.update(data[at : s[i]])
            at = e[i]
        h.update(data[at : offsets[k + 1]])
        sha.append(h.hexdigest())
    return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(sums[first[1:]] - sums[first[:-1]]), "n_spans": pa.array(np.diff(first).astype(np.int64)), "kept_sha256": pa.array(sha, pa.string())})


def text_order(doc_id: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in the order of (doc_id, tag, at), whose differences within a document are distances."""
    by = np.lexsort((at, tag, doc_id))
    d, t = doc_id[by], tag[by]
    rank = np.zeros(len(by), np.int64)
    if len(by):
        rank[by] = (np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (t[1:] != t[:-1]))]) << 32) + at[by]
    return rank


def string_runs(text: np.ndarray, size: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end) of runs of removed strings within stretches of text that stand one behind the other."""
    strings = size - length + 1
    removed = bounded_lpf(text, np.cumsum(size) - size, strings, rank, length) >= length
    head = np.cumsum(strings) - strings
    border = np.zeros(len(removed) + 1, bool)
    border[head] = border[-1] = True
    edge = np.concatenate([[False], removed, [False]])
    rise = np.flatnonzero(removed & (~edge[:-2] | border[:-1]))
    fall = np.flatnonzero(removed & (~edge[2:] | border[1:]))
    k = np.searchsorted(head, rise, "right") - 1
    return k, rise - head[k], fall - head[k] + length


def text_column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def without_repeats(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """``docs`` with removed bytes cut from text, and n_chars, if there, its new length.

    A character that a removed range's end cuts apart goes with it; null texts stay null.
    """
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    out = _removed(typed, length, hot, rows_cut, typed.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def rows_cut(rows, buf, offsets, starts, ends, first) -> pa.Table:
    data, texts = memoryview(np.ascontiguousarray(buf)), rows.column("text").to_pylist()
    for k in np.flatnonzero(np.diff(first)).tolist():
        at, kept = int(offsets[k]), []
        for i in range(first[k], first[k + 1]):
            kept.append(bytes(data[at : starts[i]]).decode("utf-8", "ignore"))
            at = int(ends[i])
        texts[k] = "".join([*kept, bytes(data[at : offsets[k + 1]]).decode("utf-8", "ignore")])
    return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
