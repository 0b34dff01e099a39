"""Nearest neighbours by largest inner product, through a hierarchical k-means tree.

Vectors get one component more that evens out the norms, so that largest inner product is
least distance. The tree's upper part is fitted on the driver over a bounded sample
(``sample`` rows). Where there are more rows than its leaves should hold, each leaf's rows
fit a part below it on an executor, again over a bounded sample, so the number of leaves
grows with the rows (65,536 at most, which bounds what is sent to the executors). Every
row is then indexed: it goes down to the leaf of the nearest centre.

A query visits leaves best first through a priority queue, in two steps. The first visits
``first_visits`` leaves by their centres' distance; its k-th best score is the query's floor. The
second follows the bound q.c + |q| m r of each leaf, r the root mean square distance of its rows
to its centre c, and of each branch, so that no leaf below has a greater one; it ends where the
best bound is not above the floor. So queries whose neighbours lie spread over many leaves
widen their visits by themselves. The margin m is calibrated on ``queries`` sampled queries and
their true neighbours among all rows: the least at which their recall is ``recall`` on the whole and
``least_recall`` for all but one in twenty of them. Scores are in double precision.

Leaves that lie together are bins of bounded size; a query is sent once to each bin with
the leaves it visits there. A leaf that holds a third of all rows is as many bins, and the
queries of a bin are dealt out too. A bin returns the best ``k`` of each query that reach
its floor.

Defined cases: vectors that are null, zero, of another length than most or hold null or
non-finite components take no part, as queries or as candidates, nor do rows without id;
rows that repeat an id are one row, with the vector that is largest as an array; with fewer
than ``k`` candidates all are returned; ties go to the smaller id; other columns are ignored;
an empty table gives an empty result; a vector whose squared length is beyond double
precision (components of about 1e154) is an error, as no distance to it can be told.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm._store import written

CHUNK = 4096


class Tree:
    """Centres of a hierarchical k-means; ``children[i]`` lists a node's children, ``leaf[i]`` its number among leaves."""

    def __init__(self, x: np.ndarray, leaves: int, branching: int = 8, seed: int = 1):
        self.centres, self.children, self.leaf = [x.mean(0)], [[]], [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        # The largest node splits first until there are enough leaves.
        open_ = [(-len(x), 0, np.arange(len(x)))]
        ended = []
        while open_ and len(open_) + len(ended) + branching - 1 <= leaves:
            _, node, rows = heapq.heappop(open_)
            centres, own = kmeans(x[rows], branching, rng)
            if len(centres) < 2:
                ended.append(node)
                continue
            for k, c in enumerate(centres):
                self.children[node].append(len(self.centres))
                heapq.heappush(open_, (-int((own == k).sum()), len(self.centres), rows[own == k]))
                self.centres.append(c)
                self.children.append([])
                self.leaf.append(-1)
        for node in sorted([n for _, n, _ in open_] + ended):
            self.leaf[node] = self.leaves
            self.leaves += 1
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row goes down to."""
        node = np.zeros(len(x), np.int64)
        while True:
            out = True
            for n in np.unique(node).tolist():
                if self.children[n]:
                    mine, kids = np.flatnonzero(node == n), np.array(self.children[n])
                    c = self.centres[kids]
                    node[mine] = kids[(x[mine] @ c.T * -2 + (c**2).sum(1)).argmin(1)]
                    out = False
            if out:
                return np.array(self.leaf)[node]

    def graft(self, below: dict[int, Tree]) -> None:
        """Puts a tree below each leaf that ``below`` names; leaves are numbered anew, those of one tree together."""
        centres, at, order = [self.centres], {leaf: node for node, leaf in enumerate(self.leaf) if leaf >= 0}, []
        for leaf in range(self.leaves):
            tree, node = below.get(leaf), at[leaf]
            if tree is None or tree.leaves < 2:
                order.append(node)
                continue
            shift = len(self.children) - 1  # its root stands for the leaf
            moved = lambda n: node if n == 0 else n + shift  # noqa: B023, E731
            self.children[node] = [moved(n) for n in tree.children[0]]
            self.children += [[moved(n) for n in kids] for kids in tree.children[1:]]
            centres.append(tree.centres[1:])
            order += [moved(n) for n in sorted((n for n, x in enumerate(tree.leaf) if x >= 0), key=lambda n: tree.leaf[n])]
        self.centres, self.leaf, self.leaves = np.concatenate(centres), [-1] * len(self.children), len(order)
        for k, node in enumerate(order):
            self.leaf[node] = k

    def leaf_centres(self) -> np.ndarray:
        out = np.zeros((self.leaves, self.centres.shape[1]))
        for node, leaf in enumerate(self.leaf):
            if leaf >= 0:
                out[leaf] = self.centres[node]
        return out

    def set_reach(self, radius: np.ndarray, margin: float) -> None:
        """reach: how far beyond a node's centre a query's bound goes; radius: of each leaf."""
        self.reach, centre = np.zeros(len(self.leaf)), self.leaf_centres()

        def below(node: int) -> list[int]:
            kids = self.children[node]
            leaves = [x for k in kids for x in below(k)] if kids else [self.leaf[node]]
            apart = np.sqrt(((centre[leaves] - self.centres[node]) ** 2).sum(1)) if kids else 0.0
            self.reach[node] = (apart + margin * radius[leaves]).max() * (1 + 1e-9) if kids else margin * radius[leaves[0]]
            return leaves

        below(0)

    def visit_above(self, q: np.ndarray, floor: float) -> list[int]:
        """Leaves whose bound is above ``floor``, best first. q has the component that evens out norms."""
        size, out = float(np.sqrt(q @ q)), []
        queue = [(-np.inf, 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound <= floor:
                break
            kids = self.children[node]
            if kids:
                for value, k in zip((self.centres[kids] @ q + size * self.reach[kids]).tolist(), kids):
                    if value > floor:
                        heapq.heappush(queue, (-value, k))
            else:
                out.append(self.leaf[node])
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves by their centres' distance, best first, ``most`` at most."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                kids = self.children[node]
                for d, k in zip(((self.centres[kids] - q) ** 2).sum(1).tolist(), kids):
                    heapq.heappush(queue, (d, k))
            else:
                out.append(self.leaf[node])
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's centre; fewer than ``k`` centres where rows are equal."""
    centres = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        own = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        used = np.flatnonzero(size)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = total[used] / size[used, None]
    return centres, (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def raised(x: np.ndarray, norm: float) -> np.ndarray:
    """With one component more, so that all rows have the same norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1, keepdims=True), 0))])


def as_query(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def best_of(q_ids, q, ids, x, k, floor, among=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of each query's best ``k`` rows by (score, -id) that reach its ``floor``; among: the rows that count for each query."""
    rough = q @ x.T
    if among is not None:
        rough[~among] = -np.inf
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    edge = 1e-9 * (1 + np.abs(np.where(np.isfinite(rough), rough, 0)).max(initial=0))
    least = floor if len(ids) <= k else np.maximum(floor, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k])
    i, j = np.nonzero((rough >= (least - edge)[:, None]) & np.isfinite(rough))
    score = np.empty(len(i))
    for a in range(0, len(i), 65536):
        # Row by row in one order of summation, so equal vectors have equal scores wherever they are.
        score[a : a + 65536] = (q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] if len(i) else i
    keep = (nth < k) & (score >= floor[i])
    return i[keep], j[keep], score[keep]


def calibrated_margin(scored: dict[int, list[tuple[float, float]]], recall: float, least_recall: float) -> float:
    """The least margin at which the sampled queries reach ``recall`` together and ``least_recall`` each, but for one in twenty.

    scored: for each query the margins at which each of its true neighbours is visited.
    """
    every = np.sort(np.concatenate([np.array(m) for m in scored.values()])) if scored else np.zeros(0)
    if not len(every):
        return 0.0
    together = every[min(len(every) - 1, int(np.ceil(recall * len(every))) - 1)]
    each = np.sort([np.sort(m)[int(np.ceil(least_recall * len(m))) - 1] for m in scored.values()])
    return float(max(together, each[int(np.ceil(0.95 * len(each))) - 1]) + 1e-9)


def bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each leaf, chunks of each bin): leaves in order go together up to CHUNK rows; a larger one is alone, in chunks."""
    bin_of, chunks, held = np.zeros(len(sizes), np.int64), [], CHUNK
    for leaf, n in enumerate(sizes.tolist()):
        if held + n > CHUNK:
            chunks.append(max(1, -(-n // CHUNK)))
            held = 0
        held += n
        bin_of[leaf] = len(chunks) - 1
    return bin_of, np.array(chunks, np.int64)


def nearest(
    vectors: DataFrame, query_every: int, id_column: str, vector_column: str, k: int = 20, recall: float = 0.97, least_recall: float = 0.9,
    sample: int = 20_000, leaf_rows: int = 64, leaves: int = 256, first_visits: int = 4, queries: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id ``query_every`` divides.

    leaf_rows: rows that a leaf should hold; leaves: the most that one fitted part of the tree has.
    """
    return search(vectors, query_every, id_column, vector_column, k, recall, least_recall, sample, leaf_rows, leaves, first_visits, queries)[0]


def search(vectors, query_every, id_column, vector_column, k=20, recall=0.97, least_recall=0.9, sample=20_000, leaf_rows=64, leaves=256, first_visits=4, queries=256) -> tuple[DataFrame, dict]:
    """nearest() and figures: rows, leaves, margin, and (a DataFrame) how many leaves and rows each query's second step visits."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = base.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    head = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("m")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if head is None:
        return spark.createDataFrame([], schema), {}
    fine, norm = fine.where(F.size("v") == head["d"]), float(np.sqrt(head["m"]))
    if not np.isfinite(norm):
        raise ValueError("a vector's squared length is beyond double precision")
    fitted = fine.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = raised(vectors_of(fitted.column("v")), norm)
    tree = Tree(x, max(1, min(leaves, len(x) // 16, -(-head["n"] // leaf_rows))))

    def place(batches):
        centre = tree.leaf_centres()
        for batch in batches:
            if batch.num_rows:
                v = raised(vectors_of(batch.column("v")), norm)
                leaf = tree.assign(v)
                apart = ((v - centre[leaf]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(apart), batch.column("id"), batch.column("v")], ["leaf", "apart", "id", "v"])

    placed = "leaf int, apart double, id long, v array<double>"
    rows = written(fine.groupBy("id").agg(F.max("v").alias("v")).mapInArrow(place, placed), "leaves")
    held = lambda: rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("apart").alias("s")).collect()  # noqa: E731  (a row for each leaf)
    counts = {r["leaf"]: r["n"] for r in held()}
    wide = {leaf: min(leaves, n // leaf_rows) for leaf, n in counts.items() if n >= 2 * leaf_rows}
    if wide:
        below: dict[int, Tree] = {}

        def fit(group: pa.Table) -> pa.Table:
            leaf = group.column("leaf")[0].as_py()
            group = group.sort_by("id")
            v = raised(vectors_of(group.column("v")), norm)
            return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(Tree(v, max(1, min(wide[leaf], len(v) // 8))))], pa.binary())})

        share = spark.createDataFrame([(leaf, sample / counts[leaf]) for leaf in wide], "leaf int, share double")
        drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        some = rows.join(F.broadcast(share), "leaf").where(drawn).select("leaf", "id", "v")
        # At most ``leaves`` trees of at most ``leaves`` leaves come back.
        for r in some.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect():
            below[r["leaf"]] = pickle.loads(r["tree"])
        tree.graft(below)
        rows = written(rows.select("id", "v").mapInArrow(place, placed), "leaves")
    size, radius = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves)
    for r in held():
        size[r["leaf"]], radius[r["leaf"]] = r["n"], np.sqrt(r["s"] / r["n"])
    asked = rows.where(F.pmod("id", F.lit(query_every)) == 0).select("id", "v")

    # Sampled queries against all rows: their true neighbours, and their floors after the first visits.
    few = asked.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(queries).toArrow().sort_by("id")
    few_ids, few_q = few.column("id").to_numpy(), vectors_of(few.column("v"))
    if not len(few_ids):
        return spark.createDataFrame([], schema), {}
    near = [set(tree.visit(q, first_visits)) for q in as_query(few_q)]

    def true_best(batches):
        held: list = [None, None]
        near_of = np.zeros((len(few_ids), tree.leaves), bool)
        for n, s in enumerate(near):
            near_of[n, list(s)] = True

        def better(old, i, ids, leaf, score):
            """The best ``k`` of each query among ``old`` and these."""
            i, ids, leaf, score = (np.concatenate(p) for p in zip(old, (i, ids, leaf, score))) if old else (i, ids, leaf, score)
            order = np.lexsort((ids, -score, i))
            i, ids, leaf, score = i[order], ids[order], leaf[order], score[order]
            keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(few_ids)))[i] < k if len(i) else np.zeros(0, bool)
            return i[keep], ids[keep], leaf[keep], score[keep]

        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                ids, leaf, v = part.column("id").to_numpy(), part.column("leaf").to_numpy(), vectors_of(part.column("v"))
                for kind in (0, 1):
                    i, j, score = best_of(few_ids, few_q, ids, v, k, np.full(len(few_ids), -np.inf), near_of[:, leaf] if kind else None)
                    held[kind] = better(held[kind], i, ids[j], leaf[j], score)
        for kind, found in enumerate(held):
            if found:
                i, ids, leaf, score = found
                yield pa.RecordBatch.from_arrays([pa.array(few_ids[i]), pa.array(np.full(len(i), kind, np.int32)), pa.array(ids), pa.array(leaf), pa.array(score)], ["query_id", "kind", "vec_id", "leaf", "score"])

    best = rows.mapInArrow(true_best, "query_id long, kind int, vec_id long, leaf int, score double")
    nth = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "vec_id"))
    true: dict[tuple[int, int], list] = {}
    for r in best.withColumn("nth", nth).where(F.col("nth") <= k).collect():  # 2 k rows for each sampled query
        true.setdefault((r["query_id"], r["kind"]), []).append((r["score"], r["leaf"]))
    needed, centre = {}, tree.leaf_centres()
    for n, (i, q) in enumerate(zip(few_ids.tolist(), as_query(few_q))):
        first = sorted((s for s, _ in true.get((i, 1), [])), reverse=True)
        floor = first[k - 1] if len(first) >= k else -np.inf
        lacks = lambda leaf: (floor - q @ centre[leaf]) / (np.sqrt(q @ q) * max(radius[leaf], 1e-12))  # noqa: B023, E731
        if (i, 0) in true:
            needed[i] = [0.0 if leaf in near[n] or floor == -np.inf else max(0.0, float(lacks(leaf))) for _, leaf in true[i, 0]]
    margin = calibrated_margin(needed, recall, least_recall)
    tree.set_reach(radius, margin)
    bin_of, chunks = bins(size)
    spread = spark.createDataFrame([(b, int(c)) for b, c in enumerate(chunks.tolist())], "bin long, chunks long")

    def route(seen_by):
        """Queries with the bins and leaves that ``seen_by`` (vector, floor) gives them."""

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    of, to, leaf_lists = [], [], []
                    for n, (q, floor) in enumerate(zip(as_query(vectors_of(part.column("v"))), part.column("floor").to_pylist())):
                        seen = np.sort(np.array(list(seen_by(q, floor)), np.int32))
                        cuts = np.flatnonzero(np.diff(bin_of[seen])) + 1 if len(seen) else []
                        for leaf_list in np.split(seen, cuts) if len(seen) else []:
                            of.append(n)
                            to.append(int(bin_of[leaf_list[0]]))
                            leaf_lists.append(leaf_list.tolist())
                    of = pa.array(of, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(leaf_lists, pa.list_(pa.int32())), *(part.column(c).take(of) for c in ("id", "v", "floor"))], ["bin", "leaves", "id", "v", "floor"])

        return lambda table: table.select("id", "v", "floor").mapInArrow(run, "bin long, leaves array<int>, id long, v array<double>, floor double")

    def binned(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bin_of[batch.column("leaf").to_numpy()]), *(batch.column(c) for c in ("leaf", "id", "v"))], ["bin", "leaf", "id", "v"])

    in_bins = rows.mapInArrow(binned, "bin long, leaf int, id long, v array<double>")

    def found(sent: DataFrame) -> DataFrame:
        """Scores of the routed queries against their leaves' rows, chunk by chunk."""
        parts = sent.groupBy("bin").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("parts"))
        dealt = F.broadcast(spread.join(parts, "bin"))  # at most one row for each leaf
        left = sent.join(dealt, "bin").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        right = in_bins.join(dealt, "bin").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if a.num_rows and b.num_rows:
                q_ids, row_ids, q, v = a.column("id").to_numpy(), b.column("id").to_numpy(), vectors_of(a.column("v")), vectors_of(b.column("v"))
                floor, leaf = a.column("floor").to_numpy(), b.column("leaf").to_numpy()
                lists = a.column("leaves").combine_chunks()
                wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                for one in np.unique(leaf).tolist():
                    mine, some = np.flatnonzero(leaf == one), of[wanted == one]
                    for s in range(0, len(some), 512):
                        n = some[s : s + 512]
                        i, j, value = best_of(q_ids[n], q[n], row_ids[mine], v[mine], k, floor[n])
                        out.append((q_ids[n[i]], row_ids[mine[j]], value))
            qs, vs, ss = (np.concatenate(y) for y in zip(*out))
            # Of a query's leaves in this bin the best ``k`` go on.
            order = np.lexsort((vs, -ss, qs))
            qs, vs, ss = qs[order], vs[order], ss[order]
            keep = np.arange(len(qs)) - np.searchsorted(qs, qs) < k
            return pa.table({"query_id": qs[keep], "vec_id": vs[keep], "score": ss[keep]})

        keys = ["bin", "chunk", "part"]
        return left.select(*keys, "leaves", "id", "v", "floor").groupBy(*keys).cogroup(right.select(*keys, "leaf", "id", "v").groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")

    def ranked(pairs: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", nth).where(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    once = written(route(lambda q, floor: tree.visit(q, first_visits))(asked.withColumn("floor", none)), "first-visits")
    first = written(ranked(found(once)), "first-found")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    lacking = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
    again = written(route(lambda q, floor: set(tree.visit_above(q, floor)) - set(tree.visit(q, first_visits)))(lacking), "later-visits")
    every = first.select("query_id", "vec_id", "score").unionByName(found(again))
    out = ranked(every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return out, {"rows": int(size.sum()), "leaves": tree.leaves, "margin": margin, "sizes": size, "later": again}
