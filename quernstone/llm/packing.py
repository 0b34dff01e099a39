"""Best-fit packing of token sequences by bin completion.

Documents become ids with an end id; one longer than a sequence is cut into pieces of whole
sequences, the first of which may be shorter. What is to be packed is then known by the
number of pieces of each length, at most ``capacity`` numbers whatever the corpus, and the
driver packs that histogram: around the largest piece left it takes a filling of the rest of
the sequence, for as many sequences as its lengths last. The way of least waste and the
best-fit decreasing one give the first incumbent. If it is above the lower bound ceil(ids / capacity),
the bound of the relaxed problem (patterns as often as any fraction) takes its place where there
are RELAXED lengths at most, and its patterns
rounded down, with the rest filled as before, may be the incumbent. If that is above the bound still,
the search goes over the undominated fillings at each node, those of equal waste too, for
as many sequences as possible, half of them, and one, until it meets the bound or its budget
of nodes or steps ends (``exact`` lifts the budget). Pieces then get their places by their rank among equal lengths,
counted in salted groups, so that no length's pieces meet in one task.

Defined cases: null and empty texts have the end id alone; rows without doc_id and rows
that repeat one are packed like any other; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm._store import with_key, written
from quernstone.llm.tokens import encoder, with_end

#: Fillings of more pieces than this are not compared for dominance, and all kept.
MANY = 8
#: Different lengths up to which the relaxed problem is solved; with more, ceil(ids / capacity) is hardly below it.
RELAXED = 256
#: Pieces of a salt, about.
SALTED = 10_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, breaks: str = "spaced", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of each document."""

    def run(batches):
        coder = encoder(tokenizer, breaks)
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            for i, j in B.slices(offsets, 4 << 20):
                ids, at = with_end(*coder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                n = np.diff(at)
                count = -(-n // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                raw, begin = ids.astype("<u4").tobytes(), at[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                out = {"doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
        B.give_back()

    return with_key(docs).mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


def fillings(room: int, left: np.ndarray, waste: int, tries: int, most: int) -> list[tuple[int, dict[int, int]]]:
    """(waste, {length: count}) of fillings of ``room``, by least waste; the first found is the best-fit one.

    left: numbers of pieces by length, up to ``room`` at least. A branch ends where even the
    best of it wastes more than the best ``most`` found; of fillings with one waste the one
    found first, of larger pieces, stands for the others, and a full one ends the enumeration.
    """
    lengths = np.flatnonzero(left[: room + 1])[::-1].tolist()
    found: dict[int, dict[int, int]] = {}
    steps = 0
    reach = np.concatenate([np.cumsum((left[lengths] * lengths)[::-1])[::-1], [0]]) if lengths else np.zeros(1)

    def down(k: int, room: int, chosen: dict[int, int]) -> None:
        nonlocal steps
        steps += 1
        while k < len(lengths) and lengths[k] > room:
            k += 1
        if k == len(lengths):
            if room not in found:
                found[room] = dict(chosen)
            return
        bound = waste if len(found) < most else min(waste, sorted(found)[most - 1] - 1)
        if found and room - reach[k] > bound:
            return
        for i in range(k, len(lengths)):
            if found and (0 in found or steps > tries):
                return
            size = lengths[i]
            if i > k and found and room - reach[i] > bound:
                return
            for count in range(min(room // size, int(left[size])), 0, -1):
                chosen[size] = count
                down(i + 1, room - size * count, chosen)
                del chosen[size]
                if found and (0 in found or steps > tries):
                    return

    down(0, room, {})
    return sorted(found.items())[:most]


def dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether the pieces of ``b`` go into the pieces of ``a`` as into bins (Martello and Toth); False where either has more than MANY pieces."""
    bins = [k for k, n in a.items() for _ in range(n)]
    items = sorted((k for k, n in b.items() for _ in range(n)), reverse=True)
    if max(len(bins), len(items)) > MANY or sum(items) > sum(bins):
        return False

    def place(k: int) -> bool:
        if k == len(items):
            return True
        for room in {x for x in bins if x >= items[k]}:
            bins[bins.index(room)] -= items[k]
            if place(k + 1):
                return True
            bins[bins.index(room - items[k])] = room
        return False

    return place(0)


def undominated(room: int, left: np.ndarray, waste: int, tries: float, most: float) -> tuple[list[dict[int, int]], int]:
    """({length: count} of the fillings of ``room`` that none other dominates, by least waste; steps taken).

    Several may have one waste, zero too. Fillings that leave room for one more piece don't
    count. After ``tries`` steps the enumeration ends; ``most`` fillings are returned at most.
    """
    lengths = np.flatnonzero(left[: room + 1])[::-1].tolist()
    reach = np.concatenate([np.cumsum((left[lengths] * lengths)[::-1])[::-1], [0]]).tolist() if lengths else [0]
    found: list[tuple[int, dict[int, int]]] = []
    steps = 0

    def down(k: int, room: int, chosen: dict[int, int]) -> None:
        nonlocal steps
        steps += 1
        while k < len(lengths) and lengths[k] > room:
            k += 1
        if all(x > room or left[x] == chosen.get(x, 0) for x in reversed(lengths)):
            if room <= waste:
                found.append((room, dict(chosen)))
            return
        for i in range(k, len(lengths)):
            if steps > tries or room - reach[i] > waste:
                return
            size = lengths[i]
            for count in range(min(room // size, int(left[size])), 0, -1):
                chosen[size] = count
                down(i + 1, room - size * count, chosen)
                del chosen[size]
                if steps > tries:
                    return

    down(0, room, {})
    kept: list[dict[int, int]] = []
    for _, f in sorted(found, key=lambda x: x[0]):
        if not any(dominates(g, f) for g in kept):
            kept = [g for g in kept if not dominates(f, g)] + [f]
        if len(kept) == most:
            break
    return kept, steps


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: count}) of best-fit decreasing over a histogram, many equal sequences at a time.

    A piece goes where it leaves least room. Once it does, the next of its length goes to the
    same sequence as long as it fits, since no other sequence has less room that fits.
    """
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(room: int, times: int, pattern: dict[int, int]) -> None:
        if times:
            open_.setdefault(room, []).append((times, pattern))

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = min((r for r, groups in open_.items() if r >= size and groups), default=None)
            if room is None:
                room = capacity
                times, pattern = -(-left // (room // size)), {}
            else:
                times, pattern = open_[room].pop()
            each = room // size
            full = min(times, left // each)
            put(room - each * size, full, pattern | {size: each})
            left, times = left - full * each, times - full
            if times and 0 < left < each:
                put(room - left * size, 1, pattern | {size: left})
                left, times = 0, times - 1
            put(room, times, pattern)
    return [group for groups in open_.values() for group in groups]


def first_way(counts: np.ndarray, capacity: int, tries: int = 4000, most: int = 3) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: count}) for each pattern used, where the filling of least waste is taken each time."""
    left, out = np.array(counts, np.int64), []
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        pattern = dict(fillings(capacity - largest, left, capacity, tries, most)[0][1])
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(int(left[k]) // v for k, v in pattern.items())
        for k, v in pattern.items():
            left[k] -= v * times
        out.append((times, pattern))
    return out


def fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of greatest worth (how many of each size) and its worth."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            value = best[c - sizes[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return pattern, float(best[capacity])


def relaxed(counts: np.ndarray, capacity: int, rounds: int = 300) -> tuple[int, list[tuple[int, dict[int, int]]]]:
    """A lower bound of the number of sequences, and (sequences, {length: count}) of the relaxed problem's patterns, rounded down.

    Columns of the linear program of patterns are made as they are needed, ``rounds`` at most. Any
    worths of the lengths bound the number: all pieces' worth by the worth of the fullest pattern.
    """
    sizes = np.flatnonzero(counts)
    demand = counts[sizes].astype(np.float64)
    each = (capacity // sizes).astype(np.float64)
    patterns, inverse, times, bound = np.diag(each), np.diag(1 / each), demand / each, 0.0
    for _ in range(rounds):
        worth = np.maximum(inverse.sum(0), 0)
        pattern, value = fullest(sizes, worth, capacity)
        bound = max(bound, float(demand @ worth) / value)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        some = np.flatnonzero(step > 1e-9)
        out = some[(times[some] / step[some]).argmin()]
        often = times[out] / step[out]
        times = np.maximum(times - often * step, 0)
        times[out], patterns[:, out] = often, pattern
        inverse[out] /= step[out]
        rest = np.arange(len(sizes)) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
    rounded, left = [], counts.copy()
    for n, pattern in zip(np.floor(times + 1e-7).astype(int).tolist(), patterns.T.astype(int)):
        n = min([n, *(int(left[s]) // k for s, k in zip(sizes.tolist(), pattern.tolist()) if k)])
        if n > 0:
            left[sizes] -= n * pattern
            rounded.append((n, {s: k for s, k in zip(sizes.tolist(), pattern.tolist()) if k}))
    return int(np.ceil(bound - 1e-6)), rounded


def least_of(ways: list[list[tuple[int, dict[int, int]]]]) -> list[tuple[int, dict[int, int]]]:
    return min(ways, key=sequences)


def complete(counts: np.ndarray, capacity: int, tries: float = 2000, most: float = 12, nodes: float = 3000, steps: float = 400_000) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: count}) for each pattern used: bin completion with branch and bound.

    The better of the first ways is the incumbent. The search then takes at each node every
    undominated filling, for as many sequences as its lengths last, for half of them and for
    one; ways that depart least from the first choices come first. It ends at the lower bound.
    tries: steps of one enumeration; most: fillings kept at a node; nodes: nodes visited;
    steps: steps of all enumerations. With all four infinite the search is exact.
    """
    total = int((np.arange(len(counts)) * counts).sum())
    bound = -(-total // capacity)
    best = least_of([first_way(counts, capacity), best_fit(counts, capacity)])
    best_count = sequences(best)
    if bound < best_count and np.count_nonzero(counts) <= RELAXED:
        least, rounded = relaxed(counts, capacity)
        bound, left = max(bound, least), counts.copy()
        for times, pattern in rounded:
            for k, v in pattern.items():
                left[k] -= times * v
        best = least_of([best, rounded + least_of([first_way(left, capacity), best_fit(left, capacity)])])
        best_count = sequences(best)
    heap: list[tuple] = [(0, 0, np.array(counts, np.int64), 0, total, None, None)] if best_count > bound else []
    tick = visited = 0
    while heap and best_count > bound and visited < nodes and steps > 0:
        departed, _, before, used, rest, path, choice = heapq.heappop(heap)
        left = before
        if choice:
            times, pattern = choice
            left = before.copy()
            for k, v in pattern.items():
                left[k] -= v * times
            path = (path, choice)
        if used + -(-rest // capacity) >= best_count:
            continue
        if not rest:
            best_count, best = used, []
            while path:
                path, choice = path
                best.append(choice)
            continue
        visited += 1
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        # Waste that a solution better than the incumbent may still have.
        spare = (best_count - 1 - used) * capacity - rest
        found, took = undominated(capacity - largest, left, min(capacity, spare), tries, most)
        left[largest] += 1
        steps -= took
        options: list[tuple[int, dict[int, int]]] = []
        for filling in found:
            pattern = dict(filling)
            pattern[largest] = pattern.get(largest, 0) + 1
            options.append((min(int(left[k]) // v for k, v in pattern.items()), pattern))
        options += [(t, pattern) for share in (2, None) for times, pattern in options if times > 1 for t in [times // share if share else 1] if share or times // 2 > 1]
        for rank, (times, pattern) in enumerate(options):
            tick -= 1
            heapq.heappush(heap, (departed + rank, tick, left, used + times, rest - times * sum(k * v for k, v in pattern.items()), path, (times, pattern)))
    return best


def sequences(patterns: list[tuple[int, dict[int, int]]]) -> int:
    return sum(times for times, _ in patterns)


def plan(counts: np.ndarray, capacity: int, exact: bool = False) -> list[tuple[int, dict[int, int]]]:
    """complete() within its budget, or without one, which may take time that grows as a power of the number of sequences."""
    return complete(counts, capacity, *[float("inf")] * 4) if exact else complete(counts, capacity)


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces in a sequence, first offset) of its patterns."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            count = pattern[size]
            rank = taken.get(size, 0)
            out.setdefault(size, []).append((rank, sequence, count, offset))
            taken[size] = rank + times * count
            offset += size * count
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(found: DataFrame, capacity: int, exact: bool = False) -> DataFrame:
    """``found``, a table of pieces, with sequence_id and offset."""
    columns = [*found.columns]
    # A number is written with the pieces, so the salt deals out equal rows too and stays as it is.
    numbered = written(found.withColumn("number", F.monotonically_increasing_id()), "pieces")
    salts = max(1, -(-numbered.count() // SALTED))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        histogram[row["length"]] = row["n"]
    places = slots(plan(histogram, capacity, exact))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("before"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    size = int(length[part[0]])
                    first, base, count, at = places[size][np.searchsorted(places[size][:, 0], rank[part], "right") - 1].T
                    sequence[part] = base + (rank[part] - first) // count
                    offset[part] = at + (rank[part] - first) % count * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*columns, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, breaks: str = "spaced", keep_ids: bool = False, exact: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece of ``docs``.

    exact: search without a budget, until no packing with fewer sequences is possible.
    """
    return packed(pieces(docs, tokenizer, end_id, capacity, breaks, keep_ids), capacity, exact)
