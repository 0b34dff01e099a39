"""Each operator's query against a brute-force version, a round trip or held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from quernstone.llm import language_model, packing, queries, repeats, simhash, toxicity
from quernstone.llm.token_files import decode_file, encode_file

A_Z = {65 + i: 97 + i for i in range(26)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def print_of(text, width=3):
    w = words(text)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, budget=2):
    """{id: least id} by comparing every pair."""
    ids, parent = list(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def cut(rows, length=100):
    """{id: (bytes, removed mask)} by looking every string up."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        out[i] = (b, gone)
    return out


def test_op10_equals_every_pair(spark, folder, texts):
    prints = {i: print_of(t) for i, t in texts}
    want = least_reachable(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, folder).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_op10_links_chains_across_blocks(spark):
    rng, fps = np.random.default_rng(1), []
    for _ in range(30):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            fps.append(x)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    fps = list(dict.fromkeys(fps))
    want = least_reachable(dict(enumerate(fps)))
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in simhash.connected(simhash.links(classes)).collect()}
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_op6_equals_every_string(spark, folder, texts, hot):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(docs, 100, hot).collect()}
    for i, (b, gone) in cut(texts).items():
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[i] == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op6_longest_previous_factors():
    rng = np.random.default_rng(11)
    for letters, many, long_ in (("ab", 40, 60), ("a", 12, 40), ("abcdefgh", 25, 120), ("ab", 1, 400)):
        for length in (12, 33, 100):
            stretches = ["".join(rng.choice(list(letters), int(rng.integers(length, length + long_)))) for _ in range(many)]
            stretches += stretches[: many // 3]
            sizes = np.array([len(t) for t in stretches])
            starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
            rank = rng.permutation(len(stretches)).astype(np.int64) << 20
            text = "".join(stretches)
            got = repeats.bounded_lpf(np.frombuffer(text.encode(), np.uint8), starts, counts, rank, length)
            strings = sorted((int(r) + k, t[k : k + length], int(c) + k) for t, r, c in zip(stretches, rank, np.cumsum(counts) - counts) for k in range(len(t) - length + 1))
            for n, (_, t, at) in enumerate(strings):
                share = (next((k for k in range(length) if t[k] != o[k]), length) for _, o, _ in strings[:n])
                assert got[at] == max(share, default=0)


def test_op6_equal_hashes_are_compared(monkeypatch):
    from quernstone.llm import _bytes as B

    monkeypatch.setattr(B, "hashes_by_parts", lambda buf, starts, ends, *_: np.full(len(starts), 7, np.uint64))
    buf = np.frombuffer(b"abcdabcdabceabcd" + b"abcde", np.uint8)
    starts, sizes = np.array([0, 4, 8, 12, 16]), np.array([4, 4, 4, 4, 5])
    zero = np.zeros(5, np.int64)
    keeps, later, first = repeats.first_of_equals(zero.astype(np.uint64), zero, buf, starts, sizes, (np.arange(5), zero, zero))
    assert keeps.tolist() == [True, False, True, False, True] and later.tolist() == [False, True, False, True, False] and first.tolist() == [0, 0, 2, 0, 4]


def test_op6_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = text(260)
    rows = [(i, text(int(rng.integers(0, 200))) + shared + text(30) + shared[:130] + str(i % 7)) for i in range(120)]
    want = {i: (len(b), int(g.sum())) for i, (b, g) in cut(rows).items()}
    for hot in (1, 40, repeats.HOT):
        got = {r[0]: (r[1], r[2]) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string"), 100, hot).collect()}
        assert got == want


def test_op6_random_small_alphabet(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("ab é\n"), 70)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 9))))) for i in range(60)] + [(60, "a" * 500), (61, "ab" * 300)]
    got = {r[0]: (r[1], r[2]) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(b), int(g.sum())) for i, (b, g) in cut(rows).items()}


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_op6_repeated_rows(spark, hot):
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = [text(150) for _ in range(8)]
    once = {i: " ".join([text(90), shared[i % 8], text(int(rng.integers(0, 60))), shared[(i * 3) % 8][5:140]]) for i in range(1, 25)}
    lost = text(80) + shared[0] + text(80)
    want = {i: (len(b), int(g.sum())) for i, (b, g) in cut([(None, lost), *once.items()]).items()}
    assert want[8][1] > 100
    # Each row three times: twice in one block and once in another, behind earlier documents or ahead of them.
    first = [(i, t) for i, t in once.items() if i < 4]
    rest = [(i, t) for i, t in [*once.items(), (None, lost)] if i is None or i >= 4]
    parts = [first, [r for r in rest for _ in range(2)], rest[::-1]]
    schema, docs = "doc_id long, text string", None
    for part in parts:
        d = spark.createDataFrame(part, schema).coalesce(1)
        docs = d if docs is None else docs.unionByName(d)
    got = collections.defaultdict(list)
    for r in repeats.digests(docs, 100, hot).collect():
        got[r[0]].append((r[1], r[2]))
    assert got == {i: [w] * (1 if i in (1, 2, 3) else 3) for i, w in want.items()}


def test_op2_round_trip(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op2_token_files(spark, folder).collect()) == want


@pytest.mark.parametrize(("name", "breaks"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_added_tokens_get_their_ids(name, breaks):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quernstone.llm import _bytes as B
    from quernstone.llm.tokens import Encoder

    path = public_tokenizers.path(name)
    t, coder = Tokenizer.from_file(path), Encoder(path, breaks)
    texts = ["a plain text", "a b <|endoftext|> c", "", "<|endoftext|>", "x<|startoftext|>y  <|endoftext|><|endoftext|> ", " <|endoftext| > c", "<|", "endoftext|>", "\n<|endoftext|>\tA b", "a b <|ENDOFTEXT|> c\u00a0d", "the last"]
    for _ in range(2):
        ids, at = coder.encode(*B.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("ids", [[], [5], [0, 2**32 - 1] * 100, list(range(128)), [7] * 1000, [1, 2, 3] * 50 + [10**9]])
def test_op2_file_format(ids):
    ids = np.array(ids, np.uint32)
    data = encode_file(np.array([3, 4]), np.array([True, False]), np.array([len(ids), 0]), ids, before=9)
    doc_ids, known, counts, back, before = decode_file(data)
    assert back.tolist() == ids.tolist() and before == 9 and known.tolist() == [True, False] and counts.tolist() == [len(ids), 0]


def check_packing(rows, want, capacity=1024):
    of = collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    bound = -(-sum(map(len, want.values())) // capacity)
    assert len(sequences) <= bound + max(2, bound // 50)


def test_op7_packs(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(queries.op7_packing(spark, folder).collect(), {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts})


def rooms_by_best_fit(pieces, capacity):
    rooms = []
    for size in sorted(pieces, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= size), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - size)
        else:
            rooms[k] -= size
    return sorted(rooms)


def test_op7_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.integers(10, 60))
        pieces = np.repeat(rng.integers(1, capacity + 1, 6), rng.integers(1, 9, 6))
        got = packing.best_fit(np.bincount(pieces, minlength=capacity + 1), capacity)
        assert sorted(capacity - sum(k * v for k, v in p.items()) for t, p in got for _ in range(t)) == rooms_by_best_fit(pieces.tolist(), capacity)


def fewest(pieces, capacity):
    """The fewest sequences, by trying every sequence for every piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= pieces[k]}:
            rest = list(rooms)
            rest[rest.index(r)] -= pieces[k]
            place(k + 1, rest)
        place(k + 1, [*rooms, capacity - pieces[k]])

    place(0, [])
    return best[0]


def test_op7_exact_without_budget():
    rng = np.random.default_rng(4)
    worse = 0
    for _ in range(120):
        capacity = int(rng.integers(12, 40))
        pieces = rng.integers(max(1, capacity // 8), 3 * capacity // 4, int(rng.integers(5, 11))).tolist()
        counts, want = np.bincount(pieces, minlength=capacity + 1), fewest(pieces, capacity)
        count = lambda p: sum(t for t, _ in p)
        assert count(packing.plan(counts, capacity, exact=True)) == want <= count(packing.plan(counts, capacity))
        worse += count(packing.best_fit(counts, capacity)) > want
    assert worse  # some cases need the search


def test_op7_never_worse_than_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(6):
        counts = np.bincount(rng.integers(200, 800, 50), minlength=1025)
        count = lambda p: sum(t for t, _ in p)
        plan = packing.plan(counts, 1024)
        assert count(plan) <= count(packing.best_fit(counts, 1024))
        used = np.zeros(1025, int)
        for times, pattern in plan:
            assert sum(k * v for k, v in pattern.items()) <= 1024
            for k, v in pattern.items():
                used[k] += times * v
        assert (used == counts).all()


@pytest.mark.parametrize("each", [1, 2, 7, 1000])
def test_op7_goes_back_past_a_full_sequence(each):
    counts = each * np.bincount([500, 300, 224, 262, 262, 267, 267, 266, 241, 241, 242], minlength=1025)
    plan = packing.plan(counts, 1024)
    used = np.zeros(1025, int)
    for times, pattern in plan:
        assert sum(k * v for k, v in pattern.items()) <= 1024
        for k, v in pattern.items():
            used[k] += times * v
    assert (used == counts).all() and sum(t for t, _ in plan) == 3 * each


def test_op7_relaxed_bound():
    """The bound never exceeds the least number of sequences, and few hot lengths end at it."""
    rng = np.random.default_rng(5)
    for _ in range(25):
        counts = np.bincount(rng.choice([3, 4, 5, 6, 7, 9, 11], rng.integers(1, 9)), minlength=14)
        least, rounded = packing.relaxed(counts, 13)
        used = sum((t * np.bincount(list(p), list(p.values()), 14) for t, p in rounded), np.zeros(14))
        assert (used <= counts).all() and all(sum(k * v for k, v in p.items()) <= 13 for _, p in rounded)
        assert least <= packing.sequences(packing.plan(counts, 13, exact=True))
    for _ in range(10):
        counts = np.zeros(1025, np.int64)
        counts[rng.choice(np.arange(30, 900), 12, replace=False)] = rng.integers(100, 4000, 12)
        plan, least = packing.plan(counts, 1024), packing.relaxed(counts, 1024)[0]
        assert packing.sequences(plan) <= least * 1.002
        used = sum(t * np.bincount(list(p), list(p.values()), 1025) for t, p in plan)
        assert (used == counts).all()


class Grams:
    """Counts of an order-3 model, and its probabilities by the recursive definition."""

    def __init__(self, train):
        self.c = [collections.Counter(g for w in train for g in zip(*([["\0begin", *w][k:] for k in range(m)]))) for m in (1, 2, 3)]
        del self.c[0]["\0begin",]
        self.history = {**self.c[0], ("\0begin",): len(train)}
        self.types = collections.Counter(g[:-1] for c in self.c[1:] for g in c)
        self.n = sum(self.c[0].values())
        self.normal = self.n + len(self.c[0]) + 1

    def p(self, history, w):
        if not history:
            return (self.c[0][w,] + 1) / self.normal
        total = self.history.get(history, 0) if len(history) == 1 else self.c[1][history]
        if not total:
            return self.p(history[1:], w)
        t = self.types[history]
        return (self.c[len(history)][(*history, w)] + t * self.p(history[1:], w)) / (total + t)


@pytest.mark.parametrize("block_bytes, bucket_bytes", [(language_model.BLOCK_BYTES, language_model.BUCKET_BYTES), (20_000, 100_000)])
def test_op5_equals_direct_counts(spark, folder, texts, block_bytes, bucket_bytes):
    tokens = {i: [*words(t), "\0end"] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    model = Grams([w for i, w in tokens.items() if not held[i]])
    rows = language_model.scores(spark.read.parquet(f"{folder}/documents.parquet"), block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r["doc_id"]]
        before = ["\0begin", *w]
        base = sum(math.log10(model.p((), x)) for x in w)
        score = sum(math.log10(model.p(tuple(before[max(0, k - 1) : k + 1]), x)) for k, x in enumerate(w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(model.c[0][x,] > 0 for x in w), model.n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


@pytest.fixture(scope="module")
def automaton():
    """(tokens, counts, automaton) of a small corpus in one block; the last text is held out."""
    rows = ["a b a b c", "b a b a", "c", "", "a b c a b d", "a x b a b q a b c " * 90]
    tokens = language_model.BlockTokens(pa.table({"doc_id": [1, 2, 3, 4, 5, 9], "text": rows}), None)
    train = np.repeat(np.arange(6) < 5, tokens.n)
    count = lambda number, size, where: np.bincount(number[where], minlength=size)
    word = count(tokens.word, len(tokens.words), train)
    word[tokens.begin] = 5
    pair = count(tokens.pair, len(tokens.pairs), train)
    triple = count(tokens.triple, len(tokens.triples), train[tokens.at])
    types = np.bincount(tokens.pair_from[pair > 0], minlength=len(word))
    pair_types = np.bincount(tokens.triple_from[triple > 0], minlength=len(pair))
    n = int(word.sum()) - 5
    normal = n + int((word > 0).sum() - 1) + 1
    return tokens, (word, pair, triple), language_model.Automaton(tokens, word, pair, triple, types, pair_types, normal)


def test_op5_weights_of_each_state_sum_to_one(automaton):
    tokens, (word, pair, *_), a = automaton
    n, end = len(word), int(np.searchsorted(tokens.words, language_model.END))
    vocabulary = np.flatnonzero((word > 0) & (np.arange(n) != tokens.begin))
    unknown = np.flatnonzero(word == 0)[:1]  # all unseen words share one place
    pairs = {(h, w): n + k for k, (h, w) in enumerate(zip(tokens.pair_from.tolist(), tokens.pair_to.tolist()))}
    triples = {(h, w): n + len(pair) + k for k, (h, w) in enumerate(zip(tokens.triple_from.tolist(), tokens.triple_word.tolist()))}
    none = int(np.flatnonzero(~a.has)[0])  # stands for n-grams that no text holds
    states = [(0, None, None), *((1 + h, h, None) for h in np.flatnonzero((word > 0) & (np.arange(n) != end)).tolist())]
    states += [(1 + n + k, int(tokens.pair_to[k]), k) for k in np.flatnonzero((pair > 0) & (tokens.pair_to != end)).tolist()]
    assert len(states) > 8
    for s, h, k in states:
        arcs = np.array([[w, pairs.get((h, w), none), triples.get((k, w), none)] for w in [*vocabulary.tolist(), *unknown.tolist()]]).T
        assert (10 ** a.step(np.full(arcs.shape[1], s), arcs)[0]).sum() == pytest.approx(1)


def test_op5_failure_arcs_and_carried_state_count(automaton):
    tokens, _, a = automaton
    arcs = a.arcs(tokens)
    weights = a.traverse(arcs, tokens.first)
    state, slow = None, []
    for i in range(len(tokens.word)):  # one token after the other, one state carried
        state = np.array([a.begin]) if i in set(tokens.first.tolist()) else state
        weight, state = a.step(state, arcs[:, i : i + 1])
        slow.append(weight[0])
    assert weights == pytest.approx(np.array(slow))
    kept, a.failure = a.failure, np.zeros(len(a.failure))
    free = a.traverse(arcs, tokens.first)
    a.failure = kept
    last = tokens.first[-2]  # training texts meet no unseen n-gram
    assert free[last:].sum() > weights[last:].sum() + 100 and free[:last] == pytest.approx(weights[:last])
    # Without a carried state every token would be scored from the root.
    assert not np.allclose(a.step(np.zeros(len(weights), int), arcs)[0], weights)


def test_counts_messages():
    from quernstone.llm import _counts as C

    rng = np.random.default_rng(3)
    keys = [np.unique(rng.integers(0, 1 << 64, 400, np.uint64)) for _ in range(2)]
    keys.append(np.unique(np.concatenate([keys[0][:100], keys[1][:50]])))
    counts = [rng.integers(0, 5, len(k)) for k in keys]
    n, total, seen = 7, collections.Counter(), collections.Counter()
    for k, c in zip(keys, counts):
        total.update(dict(zip(k.tolist(), c.tolist())))
    asked = pa.concat_tables([pa.Table.from_batches([C.requests(i, [(k, c), (k[:0], c[:0])], n)]) for i, (k, c) in enumerate(zip(keys, counts))])
    answers = pa.concat_tables([C.summed()(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in range(n)])
    assert sum(answers["tokens"].to_pylist()) == sum(total.values()) and sum(answers["types"].to_pylist()) == sum(v > 0 for v in total.values())
    for i, (k, c) in enumerate(zip(keys, counts)):
        mine = answers.filter(pa.compute.equal(answers["block_id"], i))
        (rest, shared, owner), _ = C.answered([k, k[:0]], n, mine["bucket"].to_pylist(), mine["body"].to_pylist())
        assert (rest + c).tolist() == [total[x] for x in k.tolist()]
        assert shared.tolist() == [sum(x in o for o in map(set, (y.tolist() for y in keys))) > 1 for x in k.tolist()]
        seen.update(k[owner].tolist())
    assert set(seen.values()) == {1} and set(seen) == {k for k, v in total.items() if v}


@pytest.mark.parametrize(("name", "found"), [("op6_suffix_dedup", "n_removed"), ("op8_decontamination", "contaminated"), ("op10_simhash", "component_id")])
def test_equals_sql(spark, folder, name, found):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = c.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(r[got.columns.index(found)] for r in want)


def test_xxh64_in_sql():
    import random

    from quernstone.llm.simhash_sql import xxh64

    rng, c = random.Random(1), duckdb.connect()
    texts = ["", *("".join(rng.choice("abc é😀xyz\n") for _ in range(rng.randint(1, 120))) for _ in range(500))]
    c.execute("create table t (s varchar)")
    c.executemany("insert into t values (?)", [[t] for t in texts])
    assert dict(c.sql(xxh64("select s from t")).fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


def test_op8_small_parts_change_nothing(spark, folder):
    from quernstone.llm.decontaminate import hits

    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda part: sorted((r["doc_id"], sorted(map(tuple, r["found"]))) for r in hits(docs, items, part=part).collect())
    assert rows(300) == rows(10**6)


def test_op9_families(spark):
    lines = {
        1: "text\nReleased under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.", 3: "his driver license was renewed at the office\nthe right to vote",
        4: "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", 5: None, 6: "Licensed under CC BY-NC 4.0.", 7: "copyright of the state is reserved for fishing",
    }
    from quernstone.llm.licences import licences

    got = {r["doc_id"]: (r["n_licences"], r["families"]) for r in licences(spark.createDataFrame(list(lines.items()), "doc_id long, text string")).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "Apache-2.0"), 3: (0, ""), 4: (2, "GPL,proprietary"), 5: (0, ""), 6: (1, "CC-BY-NC"), 7: (0, "")}


def test_op9_rows_without_id(spark):
    from quernstone.llm.licences import licences

    rows = [(None, "some words\nReleased under the MIT License."), (None, "All rights reserved."), (1, "Released under the MIT License.")]
    got = [(r["doc_id"], r["n_licences"], r["families"]) for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "MIT"), (None, 1, "proprietary"), (1, 1, "MIT")], key=str)


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize("width", [14, 40, 60, 75, 1000])
def test_op9_wrapped_notices(spark, width):
    import textwrap

    from quernstone.llm.licences import licences

    rows, want = [], []
    for family, notice in (("MIT", MIT), ("BSD", BSD), ("GPL", GPL)):
        for lead, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n")):
            body = [lead + x for x in textwrap.wrap(notice, width)]
            rows.append((len(rows), end.join(["Some words before the notice.", "", *body, lead, "Some words after it."])))
            want.append((1, family))
    rows.append((len(rows), "\n".join([*textwrap.wrap(MIT, width), "", "and again", *textwrap.wrap(MIT, width), "All rights reserved."])))
    got = {r["doc_id"]: (r["n_licences"], r["families"]) for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate([*want, (3, "MIT,proprietary")]))


@pytest.fixture(scope="module")
def scanner():
    from quernstone.llm import licences

    return PlainScanner(licences.Classifier())


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD"), ("Licensed under GPL-3.0-or-later", "GPL"),
        ("MIT License", "MIT"), ("zlib License", "Zlib"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("The Artistic License 2.0: licensed under the Artistic License 2.0", "Artistic-2.0"),
        ("Licensed under the European Union Public Licence", "EUPL"), ("GNU LESSER GENERAL PUBLIC LICENSE", "LGPL"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT"),
        ("SPDX-License-Identifier: WTFPL", "unknown"), ("licensed under the SIL open font license", "unknown"), ("a licensed nurse under the terms of the general contract", "unknown"),
    ],
)
def test_op9_forms(scanner, line, family):
    assert scanner.judge(line)[0] == family


def test_op9_calibration_acts(scanner):
    """The probability is a quantile of held-out texts that are no licence, not a bound put on it; it turns some of them down."""
    from quernstone.llm import licences

    loose, strict = (licences.Classifier(rounds=60, false_rate=r).least for r in (0.2, 0.001))
    assert 0 < loose < strict < 1 and scanner.model.least not in (0.5, 0.95)
    rng = np.random.default_rng(8)
    right = wrong = total = 0
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            words = t.split()
            kept = " ".join(w for w in words if len(words) < 8 or rng.random() > 0.04)
            found = scanner.judge(f"{' '.join(rng.choice(licences.OTHER, 4))} {kept} {' '.join(rng.choice(licences.OTHER, 3))}")[0]
            total, right, wrong = total + 1, right + (found == family), wrong + (found not in (family, licences.UNKNOWN))
    false = sum(scanner.judge(" ".join([*rng.permutation(t.split()), "of", "the"]))[0] != licences.UNKNOWN for t in licences.NO_LICENCE for _ in range(5))
    print(total, right, wrong, false)
    assert right >= 0.9 * total and wrong <= 0.05 * total and false == 0


class PlainScanner:
    """Every run of lines, scored in plain Python by the definition."""

    def __init__(self, model, share=0.7):
        from quernstone.llm import licences

        self.model, self.share, self.L = model, share, licences
        self.templates = [(f, self.grams(t)) for f, ts in licences.TEMPLATES.items() for t in ts]

    @staticmethod
    def grams(text):
        w = [x.strip(".-") for x in re.split(r"[^a-z0-9.\-]+", text.lower())]
        w = [x for x in w if x]
        return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}

    def judge(self, text):
        found = self.grams(text)
        z = [self.model.bias[k] + sum(self.model.weights[self.model.place[g], k] for g in found if g in self.model.place) for k in range(len(self.L.FAMILIES))]
        top = max(z)
        family, p = self.L.FAMILIES[z.index(top)], 1 / sum(math.exp(v - top) for v in z)
        share = max((len(found & t) / len(t) for f, t in self.templates if f == family), default=0)
        return (family, p) if p >= self.model.least and share >= self.share else (self.L.UNKNOWN, p)

    def scan(self, text):
        """(notices, families, best probability)."""
        lines = [x for x in re.split(r"[\r\n]+", text or "") if re.search("[A-Za-z0-9]", x)]
        found = collections.defaultdict(list)
        for i in range(len(lines)):
            between, said = 0, ""
            for k in range(i, len(lines)):
                if between >= self.L.REACH:
                    break
                said += " " + lines[k]
                between += len(re.split(r"[^A-Za-z0-9.\-]+", lines[k].strip(" "))) if k > i else 0
                family, p = self.judge(said)
                if family != self.L.UNKNOWN:
                    found[family].append((k, -i, p))
        n, best = 0, 0.0
        for runs in found.values():
            last = -1
            for end, start, p in sorted(runs):
                if -start > last:
                    n, last, best = n + 1, end, max(best, p)
        return n, ",".join(sorted(found)), best


def test_op9_equals_every_run_of_lines(spark):
    import random
    import textwrap

    from quernstone.llm import licences

    rng, rows, model = random.Random(8), [None, "", "\n\n"], licences.Classifier()
    every = [t for ts in licences.TEMPLATES.values() for t in ts]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = [w for w in rng.choice(every).split() if rng.random() > rng.choice((0, 0.1, 0.3))]
            parts += textwrap.wrap(" ".join(words), rng.choice((20, 50, 200))) + [" ".join(rng.choice(licences.OTHER) for _ in range(rng.randint(0, 6)))]
        rows.append(rng.choice(("\n", "\r\n")).join(parts))
    got = {r["doc_id"]: (r["n_licences"], r["families"], r["probability"]) for r in licences.licences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).collect()}
    plain = PlainScanner(model)
    for i, text in enumerate(rows):
        n, families, p = plain.scan(text)
        assert got[i][:2] == (n, families) and got[i][2] == pytest.approx(p, abs=1e-6), text
    assert sum(n > 0 for n, *_ in got.values()) > 25


@pytest.mark.parametrize("width", [40, 72, 1000])
def test_op9_licence_files(spark, width):
    import textwrap

    from quernstone.llm import licences

    files = {
        "MIT": [MIT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
        "BSD": [BSD, "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
        "GPL": [GPL, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "You should have received a copy of the GNU General Public License along with this program."],
        "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    }
    rows = [(k, "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in [f"Copyright (c) 2020 {k} people", *parts])) for k, parts in enumerate(files.values())]
    got = {r["doc_id"]: (r["n_licences"], r["families"]) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (len(parts), family) for k, (family, parts) in enumerate(files.items())}


def test_op9_cues_lose_no_paragraph(spark, folder, monkeypatch):
    import random

    from quernstone.llm import licences

    rng, rows = random.Random(5), []
    for t in sorted(t for ts in licences.TEMPLATES.values() for t in ts):
        for left_out in (0.0, 0.15, 0.3):
            rows.append((len(rows), " ".join(w for w in t.split() if rng.random() >= left_out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    found = []
    from pyspark.sql import functions as F

    for has_cue in (licences.has_cue, lambda low, share: F.lit(True)):
        monkeypatch.setattr(licences, "has_cue", has_cue)
        found.append(sorted((r["doc_id"], r["n_licences"], r["families"]) for r in licences.licences(docs).collect()))
    assert found[0] == found[1] and sum(n > 0 for _, n, _ in found[0]) > 40


@pytest.mark.parametrize(("query", "label", "remainder"), [(queries.op1_toxicity, "toxic", (4, 2)), (queries.op4_quality, "quality", (5, 0))])
def test_op1_and_op4_on_held_out_rows(spark, query, label, remainder):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{folder}/labels.parquet'").fetchall())
    rows = query(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % remainder[0] == remainder[1]) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([a for a, b in held if b == 1]) > 0.9


def plain_features(text, marked, stems, near=3):
    """The features of one text, word by word and byte by byte."""
    b = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    spans = lambda data, extra: [m.span() for m in re.finditer(rb"[A-Za-z\x80-\xff" + extra + rb"]+", data)]
    words = [(s, e, low[s:e]) for s, e in spans(b, b"")]
    n, size = max(len(words), 1), max(len(b), 1)
    insults, seconds = {w.encode() for w in toxicity.INSULTS}, {w.encode() for w in toxicity.SECOND_PERSON}
    is_insult, is_mark = [w in insults for *_, w in words], [w in marked for *_, w in words]
    you = [k for k, (*_, w) in enumerate(words) if w in seconds]
    close = sum((i or m) and any(abs(k - y) <= near for y in you) for k, (i, m) in enumerate(zip(is_insult, is_mark)))
    capital, letter = lambda c: 65 <= c <= 90, lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    mixed = [b[s:e] for s, e in spans(b, rb"0-9@$!*") if any(map(letter, b[s:e])) and not all(map(letter, b[s:e])) and letter(b[s]) and letter(b[e - 1])]
    leet = {ord(k): ord(v) for k, v in toxicity.LEET.items()} | {c: c + 32 for c in range(65, 91)}
    hidden = sum(bytes(leet.get(c, c) for c in w) in insults for w in mixed)
    stretched = sum(letter(low[k]) and low[k] == low[k - 1] == low[k - 2] for k in range(2, len(low)))
    stem = sum(w[: toxicity.STEM] in stems for *_, w in words)
    return [
        math.log1p(len(words)), math.log1p(len(b)), sum(is_insult) / n, math.log1p(sum(is_insult)), sum(is_mark) / n, math.log1p(sum(is_mark)), stem / n, math.log1p(stem), len(you) / n,
        math.log1p(close), sum(map(capital, b)) / size, sum(e - s > 1 and all(map(capital, b[s:e])) for s, e, _ in words) / n,
        sum(33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in b) / size, b.count(b"!") / size, sum(48 <= c < 58 for c in b) / size, len(mixed) / n, math.log1p(hidden), stretched / size,
    ]


def plain_trees(trees, row):
    """The sum of the trees' leaves, node by node."""
    total = trees.base
    for feature, cut, value in trees.nodes:
        node = 0
        for _ in range(trees.depth):
            f = feature[node]
            if f < 0:
                break
            node = 2 * node + 1 + (sum(e < row[f] for e in trees.edges[f]) > cut[node])
        total += trees.rate * value[node]
    return total


def test_op1_scores_equal_plain_scores(texts):
    from quernstone.llm import _bytes as B

    odd = [None, "", "aa", "aaa sooo you 1d1ot", "YOU ID10T!!! you are STUPID, sh1t", "ab1 1ab a1b x@y", "é" * 9, "i" * 5000 + " trash you"]
    every = odd + [t for _, t in texts[:60]]
    marked = [w for t in every[8:20] for w in re.findall("[a-z]+", t)][::7]
    stems = [w[: toxicity.STEM] for w in marked[::3]]
    lexicon = toxicity.hashes_of(marked), toxicity.hashes_of(stems)
    got = toxicity.features(*B.column_bytes(pa.array(every, pa.string())), lexicon)
    want = np.array([plain_features(t, {w.encode() for w in marked}, {w.encode() for w in stems}) for t in every])
    assert got == pytest.approx(want)
    label = (got[:, 2] + got[:, 10] > np.median(got[:, 2] + got[:, 10])).astype(float)
    trees = toxicity.Trees(trees=12, least=1.0).fit(got, label)
    sums = trees.predict(got)
    assert sums == pytest.approx(np.array([plain_trees(trees, r) for r in got])) and len(set(np.round(sums, 6))) > 2
    x, y = toxicity.isotonic(sums, label)
    between = lambda v: y[0] if v <= x[0] else y[-1] if v >= x[-1] else next(y[k] + (v - x[k]) / (x[k + 1] - x[k]) * (y[k + 1] - y[k]) for k in range(len(x) - 1) if x[k] <= v <= x[k + 1])
    assert np.interp(sums, x, y) == pytest.approx(np.array([between(v) for v in sums]))


def test_op1_isotonic_and_trees():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), weight=0)
    assert y.tolist() == [0, 0.5, 1]
    z = np.random.default_rng(0).normal(size=(2000, 3))
    label = ((z[:, 0] > 0) ^ (z[:, 1] > 0)).astype(float)
    assert ((toxicity.Trees().fit(z, label).predict(z) > 0) == label).mean() > 0.95


def test_op4_sum_of_squares_identity():
    from quernstone.llm import quality

    rng = np.random.default_rng(0)
    w = rng.normal(size=(quality.BUCKETS + len(quality.NAMES), 1 + quality.RANK))
    bucket, x, z = np.array([3, 9, 700]), rng.normal(size=3), rng.normal(size=(1, len(quality.NAMES)))
    got, _ = quality.Machine._sums(w, np.zeros(3, int), bucket, x, z)
    ids, values = np.concatenate([bucket, quality.BUCKETS + np.arange(z.shape[1])]), np.concatenate([x, z[0]])
    pairs = sum(w[ids[i], 1:] @ w[ids[j], 1:] * values[i] * values[j] for i in range(len(ids)) for j in range(i))
    assert got[0] == pytest.approx(w[ids, 0] @ values + pairs)


def test_op3_recall_order_and_scores(spark, folder):
    rows = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = collections.defaultdict(list)
    for r in queries.op3_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        true = ids[np.lexsort((ids, -s))[:20]]
        mine = found[q]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        hit, total = hit + len({*true} & {r["vec_id"] for r in mine}), total + 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("clusters", [0, 12])
def test_op3_lower_trees(spark, clusters):
    """Small samples and leaves, so that executors fit trees below the first: recall as a whole and of single queries."""
    from quernstone.llm import neighbours

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    if clusters:
        x = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 3000)] * 3 + 0.3 * x
        x[:1000] = x[0] + 0.05 * rng.normal(size=(1000, 16))  # a third in one group
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    found, figures = neighbours.search(table, 20, "vec_id", "embedding", 20, sample=400, leaf_rows=16, leaves=12)
    rows = collections.defaultdict(set)
    for r in found.collect():
        rows[r["query_id"]].add(r["vec_id"])
    # More leaves than one fitted tree may have, none left out; sizes add up to all rows.
    assert figures["leaves"] > 12 and figures["rows"] == 3000 == figures["sizes"].sum()
    share = []
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        share.append(len(rows[q] & {*np.lexsort((np.arange(3000), -score))[:20].tolist()}) / 20)
    assert np.mean(share) >= 0.95 and np.mean(np.array(share) >= 0.9) >= 0.9


def test_op3_beyond_double_precision(spark):
    from quernstone.llm import neighbours

    table = spark.createDataFrame([(0, [1e160, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="beyond"):
        neighbours.nearest(table, 20, "vec_id", "embedding")


def test_pipeline_stages_against_brute_force(spark, folder):
    import corpus_pipeline as cp
    from quernstone.llm._store import written

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns, docs_before = docs.columns, docs
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = written(stage(spark, docs, folder), "test-stage")
        seen.append(name)
        if name == "best-fit packing":
            import public_tokenizers
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check_packing(docs.collect(), {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in before.items()})
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "SimHash near-dedup":
            least = least_reachable({i: print_of(t) for i, t in before.items()})
            assert set(after) == {i for i, c in least.items() if i == c}
        elif name == "suffix-array dedup":
            assert after == {i: bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore") for i, (b, g) in cut(sorted(before.items())).items()}
        elif name == "benchmark decontamination":
            items = [[w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(A_Z)) if w] for (t,) in duckdb.sql(f"select text from '{folder}/benchmark.parquet'").fetchall()]
            windows = {f" {' '.join(w[k : k + 10])} " for w in items for k in range(max(len(w) - 9, 1))}
            flat = {i: f" {' '.join(w for w in re.split('[\x00-\x2F\x3A-\x60\x7B-\x7F]+', t.translate(A_Z)) if w)} " for i, t in before.items()}
            assert set(after) == {i for i, t in flat.items() if not any(w in t for w in windows)}
        else:
            kept = plain_quality(spark, docs_before, folder, before)
            assert set(after) == {i for i, p in kept.items() if p >= 0.3} and len(after) < len(before)
        docs_before = docs
    assert len(seen) == 5


def plain_statistics(text):
    """Statistics and shares of word buckets of one text, byte by byte."""
    from quernstone.llm import _bytes as B
    from quernstone.llm import quality

    raw = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in found]
    n, size = max(len(found), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x]
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    odd = b"*%&$#@^~<>{}[]\\|_="
    part = lambda ok: sum(ok(c) for c in raw) / size
    count = collections.Counter(low)
    stats = [
        math.log1p(len(found)), math.log1p(len(raw)), sum(map(len, found)) / n, len(count) / n, max(count.values(), default=0) / n, part(lambda c: 65 <= c <= 90), part(lambda c: 48 <= c <= 57), part(lambda c: c in signs), part(lambda c: c in odd),
        part(lambda c: c == 33), part(lambda c: c == 124), part(lambda c: c >= 128), math.log1p(size / max(len(lines), 1)), 1 - len({*lines}) / max(len(lines), 1), sum(w[-1] in odd for w in found) / n, sum(2 * sum(65 <= c <= 90 for c in w) > len(w) for w in found) / n,
    ]
    buckets = collections.Counter()
    for w, k in count.items():
        hashed = int(B.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        buckets[(hashed >> 24) % quality.BUCKETS] += k / n
    return stats, buckets


def test_op4_features_equal_plain_ones(texts):
    from quernstone.llm import _bytes as B
    from quernstone.llm import quality

    some = [t for _, t in texts[:150]] + [None, "", "   \n\n ", "ONE two TWO two\nline\nline\n\n", "é!|* a* 12", "x" * 3000, "SHOUT " * 50]
    row, bucket, share, stats = quality.inputs(*B.column_bytes(pa.array(some, pa.string())))
    for i, t in enumerate(some):
        want, buckets = plain_statistics(t)
        assert stats[i] == pytest.approx(want), (i, quality.NAMES)
        assert dict(zip(bucket[row == i].tolist(), share[row == i].tolist())) == pytest.approx(dict(buckets))


def plain_quality(spark, docs, folder, texts):
    """Scores of the factorisation machine with every pair of inputs multiplied out."""
    from quernstone.llm import _bytes as B
    from quernstone.llm import quality

    m = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    row, bucket, share, stats = quality.inputs(*B.column_bytes(pa.array(list(texts.values()), pa.string())))
    x = np.zeros((len(texts), len(m.factors)))
    x[row, bucket] = np.sqrt(share)
    x[:, quality.BUCKETS :] = np.clip((stats - m.middle) / m.scale, -5, 5)
    linear, v = m.factors[:, 0], m.factors[:, 1:]
    every = v @ v.T
    np.fill_diagonal(every, 0)
    z = m.bias + x @ linear + 0.5 * ((x @ every) * x).sum(1)
    return dict(zip(texts, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))


def test_pipeline_on_nulls_repeats_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    long_ = "one long text of many words " * 3000
    rows = [(1, "good words stand here in a row", "en", "a", 30), (None, "good words without an id stand here", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, long_, "en", "b", 1), (4, long_, "en", "b", 1), (5, long_, "en", "b", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, found in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = cp.run(spark, folder).collect()
        if not found:
            assert out == []
            continue
        # Without labels none is rejected. Texts without words are alike: one of them stays, with the end id alone.
        whole = {r["doc_id"] for r in out if r["piece"] == 0}
        assert whole == {1, None, 2, 4} and sum(r["piece"] == 0 for r in out) == 4
