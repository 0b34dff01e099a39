"""Token ids of documents in files of patched frame-of-reference blocks.

A file: ``QPFR``, a version, the numbers of documents and ids, the ids that stand before it
in its partition, the length of a block; then the documents' ids and lengths; then an index
with each block's byte offset, minimum, width and number of exceptions; then the blocks.
A block's ids have the block's minimum subtracted. They are packed at the width that holds
the given percentile of them; what doesn't fit leaves its upper bits in an exception list.

Documents are range-partitioned by doc_id, so that files in order of partition and number hold
documents in order; a file has a name of its own, and those that count are named in the
manifest, a table: what a lost task left behind is named nowhere.

Defined cases: null and empty texts have the end id alone; rows without doc_id come first;
rows that repeat a doc_id are written each, in the order of a hash of their texts; other
columns are ignored; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import dealt, filesystem, new_folder, with_key, written
from quernstone.llm.tokens import encoder, with_end

MAGIC, VERSION, BLOCK = b"QPFR", 1, 128
HEADER = struct.Struct("<4sHHQQQ")
FILE_IDS = 2 << 20
#: Documents of a range, about.
RANGE = 4096


def encode_file(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, before: int = 0, percentile: float = 0.9) -> bytes:
    """A file's bytes. known: whether a document has an id; before: ids of the partition's earlier files."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.int64)
    full[:n] = ids
    if n:
        full[n:] = full[n - 1]
    full = full.reshape(blocks, BLOCK)
    least = full.min(1, initial=1 << 32)
    rest = (full - least[:, None]).astype(np.uint32)
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.ceil(np.log2(np.partition(rest, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.uint8)
    over = (rest >> np.minimum(width, 31)[:, None]) * (width < 32)[:, None]
    block_of, place = np.nonzero(over)
    exceptions = np.bincount(block_of, minlength=blocks)
    packed_size = width.astype(np.int64) * (BLOCK // 8)
    size = packed_size + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint8)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        if w:
            for a in range(0, len(mine), 2048):
                some = mine[a : a + 2048]
                bits = np.unpackbits(rest[some].astype("<u4").view(np.uint8).reshape(len(some), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
                out[start[some][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    nth = np.arange(len(block_of)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = start[block_of] + packed_size[block_of]
    out[at + nth] = place
    values = np.ascontiguousarray(over[block_of, place].astype("<u4")).view(np.uint8).reshape(-1, 4)
    out[(at + exceptions[block_of] + 4 * nth)[:, None] + np.arange(4)] = values
    head = HEADER.pack(MAGIC, VERSION, BLOCK, len(doc_ids), n, before)
    index = (start.astype("<u8"), least.astype("<u4"), width, exceptions.astype("u1"))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), counts.astype("<u4").tobytes(), *(x.tobytes() for x in index), out.tobytes()])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, known, counts, ids, before) of a file's bytes."""
    magic, version, block, docs, n, before = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at, blocks = HEADER.size, -(-n // block)

    def column(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, known, counts = column("<i8", docs), column("u1", docs).astype(bool), column("<u4", docs)
    start, least, width, exceptions = column("<u8", blocks).astype(np.int64), column("<u4", blocks), column("u1", blocks), column("u1", blocks).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at)
    rest = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        for a in range(0, len(mine) if w else 0, 2048):
            some = mine[a : a + 2048]
            bits = np.unpackbits(body[start[some][:, None] + np.arange(w * block // 8)], axis=1, bitorder="little").reshape(len(some), block, w)
            whole = np.zeros((len(some), block, 32), np.uint8)
            whole[:, :, :w] = bits
            rest[some] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    block_of = np.repeat(np.arange(blocks), exceptions)
    nth = np.arange(len(block_of)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = start[block_of] + width[block_of].astype(np.int64) * (block // 8)
    upper = np.ascontiguousarray(body[(base + exceptions[block_of] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    rest[block_of, body[base + nth]] |= upper << width[block_of]
    return doc_ids, known, counts, (rest + least[:, None]).ravel()[:n], before


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, breaks: str = "words", percentile: float = 0.9) -> DataFrame:
    """Writes the ids of ``docs`` into files in ``folder``, a shared folder's URI; returns the manifest (part, file, ids, documents, name)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        coder = encoder(tokenizer, breaks)
        held: list[tuple] = []

        def flush():
            nonlocal held, seq, before
            doc_ids, known, counts, ids = (np.concatenate(x) for x in zip(*held))
            name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.qpf"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(encode_file(doc_ids, known, counts, ids, before, percentile))
            row = pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in (("part", part), ("file", seq), ("ids", len(ids)), ("documents", len(doc_ids)))} | {"name": pa.array([name])})
            held, seq, before = [], seq + 1, before + len(ids)
            return row

        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            column = batch.column("doc_id")
            doc_ids, known = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
            for i, j in B.slices(offsets, 4 << 20):
                ids, at = with_end(*coder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                held.append((doc_ids[i:j], known[i:j], np.diff(at), ids))
                if sum(len(x[3]) for x in held) >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()
        B.give_back()

    rows = with_key(docs)
    n = max(1, -(-rows.count() // RANGE))
    # The order is total but for equal rows, so a task that runs again cuts the same files; rows of one doc_id may span ranges.
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("tag"), F.monotonically_increasing_id().alias("nth"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tag", "nth").sortWithinPartitions("doc_id", "tag", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, file long, ids long, documents long, name string"), "token-files")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the files of ``manifest`` in ``folder``."""
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()  # one row for each partition
    if not totals:
        empty = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
        return spark.createDataFrame([], empty)
    at, offset = 0, {}
    for row in totals:
        offset[row["part"]] = at
        at += row["n"]

    def run(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist()):
                with store.open_input_stream(f"{path}/{name}") as data:
                    doc_ids, known, counts, ids, before = decode_file(data.read())
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                out = {"doc_id": pa.array(doc_ids, mask=~known), "start": pa.array(ends - counts + before + offset[part]), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
                del doc_ids, known, counts, ids, raw, out
                B.give_back()

    files = dealt(manifest.select("part", "name"), "name", manifest.count(), 4)
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, breaks: str = "words", keep_ids: bool = False) -> DataFrame:
    """Writes the ids of ``docs`` into files of a new shared folder and returns what read_ids() finds there."""
    folder = new_folder(docs.sparkSession, "ids")
    manifest = write_ids(docs, folder, tokenizer, end_id, breaks)
    return read_ids(docs.sparkSession, folder, manifest, keep_ids)
