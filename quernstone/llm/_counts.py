"""Counts by 64-bit keys that blocks of documents share.

Each block sends its distinct keys, once each and with its own counts, to buckets, which are
ranges of keys; a bucket adds up and answers every block that asked: what the others counted
(``rest``), whether any other block asked (``shared``), and whether the block is the first
that counted any (``owner``). A message
is one compressed run of bytes: sorted keys as differences, laid out byte by byte, so that
a key costs fewer than eight bytes and a count of one next to nothing. There are no more
messages than keys, however many blocks and buckets there are.

A message has sections, each with keys of its own kind. Keys must be spread evenly over 64 bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

REQUEST = "bucket long, block_id long, body binary"
ANSWER = "bucket long, block_id long, types long, tokens long, body binary"


def squeeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned 64-bit integers as compressed byte planes."""
    raw = b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
    return struct.pack(f"<B{len(arrays)}I", len(arrays), *map(len, arrays)) + pa.Codec("zstd").compress(raw, asbytes=True)


def unsqueeze(body: bytes) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{body[0]}I", body, 1)
    raw = np.frombuffer(pa.Codec("zstd").decompress(body[1 + 4 * body[0] :], 8 * sum(sizes)), np.uint8)
    cuts = np.cumsum([0, *sizes]) * 8
    return [np.ascontiguousarray(raw[a:b].reshape(8, -1).T).view("<u8").ravel() for a, b in zip(cuts[:-1], cuts[1:])]


def borders(keys: np.ndarray, n: int) -> np.ndarray:
    """The places where each of ``n`` buckets begins among sorted ``keys``, and the end."""
    low = np.array([(b << 64) // n for b in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, low), len(keys))


def requests(block_id: int, sections: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.RecordBatch:
    """A block's messages. sections: (sorted distinct keys, counts) of each kind."""
    cuts, rows = [borders(keys, n) for keys, _ in sections], []
    for b in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
        arrays = []
        for (keys, counts), c in zip(sections, cuts):
            own = keys[c[b] : c[b + 1]]
            arrays += [np.diff(own, prepend=np.uint64(0)), counts[c[b] : c[b + 1]]]
        rows.append((b, squeeze(arrays)))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([block_id] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "block_id", "body"])


def summed(skip: int | None = None):
    """The function that answers a bucket's messages; types and tokens count the first section's keys but ``skip``."""

    def add_up(group: pa.Table) -> pa.Table:
        asked = [unsqueeze(x) for x in group.column("body").to_pylist()]
        answers: list[list[np.ndarray]] = [[] for _ in asked]
        types = tokens = 0
        for k in range(0, len(asked[0]), 2):
            keys = np.concatenate([np.cumsum(a[k], dtype=np.uint64) for a in asked])
            counts = np.concatenate([a[k + 1] for a in asked]).astype(np.int64)
            distinct, inverse = np.unique(keys, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, inverse, counts)
            if k == 0:
                some = (total > 0) & (distinct != np.uint64(skip)) if skip is not None else total > 0
                types, tokens = int(some.sum()), int(total[some].sum())
            askers = np.bincount(inverse, minlength=len(distinct))
            reply = (total[inverse] - counts) * 4 + 2 * (askers[inverse] > 1)
            some, first = np.flatnonzero(counts)[::-1], np.full(len(distinct), -1)
            first[inverse[some]] = some  # of several the last one stays, which is the first asked
            reply[first[first >= 0]] += 1
            at = np.cumsum([0, *(len(a[k]) for a in asked)])
            for answer, i, j in zip(answers, at[:-1], at[1:]):
                answer.append(reply[i:j])
        once = [1] + [0] * (len(asked) - 1)
        return pa.table({"bucket": group.column("bucket"), "block_id": group.column("block_id"), "types": pa.array([types * x for x in once], pa.int64()), "tokens": pa.array([tokens * x for x in once], pa.int64()), "body": pa.array([squeeze(a) for a in answers], pa.binary())})

    return add_up


def answered(keys: list[np.ndarray], n: int, buckets: list[int], bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rest, shared, owner) of each section's ``keys``, as they were asked for."""
    out = [(np.zeros(len(k), np.int64), np.zeros(len(k), bool), np.zeros(len(k), bool)) for k in keys]
    cuts = [borders(k, n) for k in keys]
    for b, body in zip(buckets, bodies):
        for (rest, shared, owner), c, reply in zip(out, cuts, unsqueeze(body)):
            rest[c[b] : c[b + 1]] = (reply >> np.uint64(2)).astype(np.int64)
            shared[c[b] : c[b + 1]] = (reply & np.uint64(2)).astype(bool)
            owner[c[b] : c[b + 1]] = (reply & np.uint64(1)).astype(bool)
    return out
