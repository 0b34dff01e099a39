"""Document quality by a factorisation machine.

Inputs: hashed words (each bucket's share of the document's words), structure statistics
and the text's size as metadata. The score is a linear part and pairwise interactions of
low rank, summed in linear time by the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is trained on the driver over a bounded sample of labelled rows (``rows``) by
Adam on the logistic loss. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts have no words and zero statistics and get the score
of that; rows without doc_id are scored and count as not held out; without labelled rows
of both kinds every score is the share of label 1 (0.5 if there are none); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import with_key
from quernstone.llm.labelled import held_out, sample

BUCKETS, RANK = 1 << 12, 6
NAMES = ("words", "length", "word_length", "distinct", "commonest", "capitals", "digits", "signs", "odd_signs", "exclamations", "bars", "accents", "line_length", "repeated_lines", "signed_words", "shouted")
_CLASS = np.zeros((256, 7), bool)
for _i, _of in enumerate((range(65, 91), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], [ord(c) for c in "*%&$#@^~<>{}[]\\|_="], [33], [124], range(128, 256))):
    _CLASS[list(_of), _i] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def inputs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share, statistics): the hashed words of each text, sorted by row, and a row of NAMES for each."""
    parts = [(i, *_inputs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in B.slices(offsets)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(NAMES)))
    return np.concatenate([i + r for i, r, *_ in parts]), *(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))


def _inputs(buf: np.ndarray, at: np.ndarray):
    n_rows = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    text = B.LOWER[buf]
    starts, ends, first = B.words(text, at)
    n = np.diff(first)
    many = np.maximum(n, 1).astype(np.float64)
    row = np.repeat(np.arange(n_rows), n)
    word = B.span_hashes(text, starts, ends)
    pair = np.sort((row.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(pair)))
    of = (pair[new] >> np.uint64(40)).astype(np.int64)
    distinct, commonest = np.bincount(of, minlength=n_rows), np.zeros(n_rows)
    np.maximum.at(commonest, of, count)
    key, inverse = np.unique((of << 12) | (pair[new] & np.uint64(BUCKETS - 1)).astype(np.int64), return_inverse=True)
    share = np.bincount(inverse, count, len(key)) / many[key >> 12] if len(key) else np.zeros(0)
    per = []
    for k in range(_CLASS.shape[1]):
        total = np.concatenate([[0], np.cumsum(_CLASS[buf, k], dtype=np.int64)])
        per.append((total[at[1:]] - total[at[:-1]]) / size)
    s, e, f = B.words(buf, at, NEWLINE)
    lines = np.maximum(np.diff(f), 1).astype(np.float64)
    line_row = np.repeat(np.arange(n_rows), np.diff(f))
    line = np.unique((line_row.astype(np.uint64) << np.uint64(40)) | (B.span_hashes(buf, s, e) >> np.uint64(24)))
    different = np.bincount((line >> np.uint64(40)).astype(np.int64), minlength=n_rows)
    total = lambda x: np.bincount(row, x, n_rows)
    caps = np.concatenate([[0], np.cumsum(_CLASS[buf, 0], dtype=np.int64)])
    length = (ends - starts).astype(np.float64)
    signed = _CLASS[buf[ends - 1], 3] if len(ends) else np.zeros(0)
    shouted = (caps[ends] - caps[starts]) * 2 > length
    stats = np.stack([np.log1p(n), np.log1p(np.diff(at)), total(length) / many, distinct / many, commonest / many, *per, np.log1p(size / lines), 1 - different / lines, total(signed) / many, total(shouted) / many], axis=1)
    return key >> 12, key & (BUCKETS - 1), share, stats


class Machine:
    """Bias, weights and factors; inputs are word buckets and standardised statistics."""

    def __init__(self, texts: pa.Array, label: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 1):
        self.share = float(label.mean()) if len(label) else 0.5
        self.factors = None
        if not 0 < label.sum() < len(label):
            return
        row, bucket, share, stats = inputs(*B.column_bytes(texts))
        self.middle, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        rng, d = np.random.default_rng(seed), BUCKETS + len(NAMES)
        w = np.zeros((d, 1 + RANK))
        w[:, 1:] = rng.normal(0, 0.05, (d, RANK))
        bias, moments, step = np.log(self.share / (1 - self.share)), [np.zeros_like(w), np.zeros_like(w)], 0
        z = self._standard(stats)
        first = np.searchsorted(row, np.arange(len(label) + 1))
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for a in range(0, len(order), 256):
                rows, step = np.sort(order[a : a + 256]), step + 1
                some = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows]) if len(rows) else rows
                r, b, x = np.searchsorted(rows, row[some]), bucket[some], self._word(share[some])
                out, total = self._sums(w, r, b, x, z[rows])
                g = (1 / (1 + np.exp(-(out + bias))) - label[rows]) / len(rows)
                grad = np.zeros_like(w)
                np.add.at(grad[:, 0], b, g[r] * x)
                grad[BUCKETS:, 0] = z[rows].T @ g
                for f in range(1, 1 + RANK):
                    np.add.at(grad[:, f], b, g[r] * x * (total[r, f - 1] - w[b, f] * x))
                    grad[BUCKETS:, f] = (g[:, None] * z[rows] * (total[:, f - 1 : f] - w[BUCKETS:, f] * z[rows])).sum(0)
                grad += decay * w
                moments[0] += 0.1 * (grad - moments[0])
                moments[1] += 0.01 * (grad**2 - moments[1])
                w -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
                bias -= rate * g.sum()
        self.bias, self.factors = bias, w

    def _standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.middle) / self.scale, -5, 5)

    @staticmethod
    def _word(share: np.ndarray) -> np.ndarray:
        return np.sqrt(share)

    @staticmethod
    def _sums(w, row, bucket, x, z):
        """The score without bias, and the factor sums of each row."""
        n, size = len(z), BUCKETS
        linear = np.bincount(row, w[bucket, 0] * x, n) + z @ w[size:, 0]
        total, pairs = np.zeros((n, RANK)), np.zeros(n)
        for f in range(1, 1 + RANK):
            vx = w[bucket, f] * x
            total[:, f - 1] = np.bincount(row, vx, n) + z @ w[size:, f]
            pairs += 0.5 * (total[:, f - 1] ** 2 - np.bincount(row, vx**2, n) - (z**2) @ w[size:, f] ** 2)
        return linear + pairs, total

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(offsets) - 1, self.share)
        out = []
        for i, j in B.slices(offsets):
            row, bucket, share, stats = _inputs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            value, _ = self._sums(self.factors, row, bucket, self._word(share), self._standard(stats))
            out.append(1 / (1 + np.exp(-np.clip(value + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, rows: int = 5_000) -> Machine:
    """A machine for label 1 of ``quality`` from ``rows`` labelled rows at most that aren't held out."""
    table = sample(docs, labels, "quality", modulus, remainder, rows).select("doc_id", "text", "label").toArrow().sort_by("doc_id").combine_chunks()
    return Machine(table.column("text").combine_chunks(), table.column("label").to_numpy().astype(np.float64))


def quality(docs: DataFrame, model: Machine, modulus: int = 5, remainder: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            score, ids = model.scores(*B.column_bytes(batch.column("text"))), batch.column("doc_id")
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": pa.array(held_out(ids.to_pylist(), modulus, remainder)), "score": pa.array(score), "predicted": pa.array((score >= cut).astype(np.int32))})
        B.give_back()

    return with_key(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, model: Machine, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, all columns kept; all rows where no labels of both kinds trained the model."""
    if model.factors is None:
        return docs
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keep = model.scores(*B.column_bytes(batch.column("text"))) >= cut
            yield batch.select(["row"]).filter(pa.array(keep))
        B.give_back()

    kept = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}")
    return kept.select("row.*")
