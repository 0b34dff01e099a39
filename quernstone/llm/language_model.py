"""Language-model scores by a weighted backoff automaton learnt from the corpus.

Tokens of a document are its words (A-Z lower-cased, cut at ASCII white space) and one end.
The automaton is of third order. It has a root, a state for the beginning, one for each word
and one for each word pair of the training documents. With c() the counts there, p0(w) =
(c(w) + 1) / (N + V + 1) and t(h) the number of different tokens behind a state, smoothed
after Witten and Bell, these are its weights, as log10:

    arc of the root by w            p0(w), also for words never seen
    arc of state h by w, c(hw) > 0  (c(hw) + t(h) p(w | h')) / (c(h) + t(h))
    failure arc of h to h'          t(h) / (c(h) + t(h))

h' is h without its first word. Weights that leave a state sum to one. A text is scored in one traversal from left to right, which carries the state:
at each token it follows failure arcs until the state has an arc, and takes it to the state
of the longest history that there is.

Counts come from all training documents by three exchanges of hashed n-grams (``_counts``): words
and pairs; then numbers of different pairs by word, and triples; then numbers of different
triples by pair, which the blocks that are the first to hold a triple count. A block doesn't ask
for a triple one of whose pairs occurs in its own texts alone: all its occurrences are there.
Nor for t() of a pair that occurs once, which is one, or of one in its own texts alone.
A block then holds the part of the automaton that its texts can reach. Nothing that grows
with the corpus is broadcast or collected.

Defined cases: null and empty texts are the end alone; rows without doc_id train (they
have no remainder); rows that repeat a doc_id count and score each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import _bytes as B
from quernstone.llm import _counts as C
from quernstone.llm._store import blocks, bucket_count, dealt, read_block, with_key, written

BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 16 << 20
#: Hashes that stand for the end token and for the beginning; words' hashes come from span_hashes().
END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)
#: Tokens of a text that one lane of the traversal takes; longer texts take several.
LANE = 256


class BlockTokens:
    """The tokens of a block of documents, as hashes and as numbers among the block's n-grams."""

    def __init__(self, rows: pa.Table, held_out_of: tuple[int, int] | None):
        buf, offsets = B.column_bytes(rows.column("text"))
        parts, counts = [], []
        for i, j in B.slices(offsets):
            text, at = B.LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = B.words(text, at)
            n = np.diff(first)
            behind = np.cumsum(n + 1)
            out = np.empty(behind[-1], np.uint64)
            out[behind - 1] = END
            own = np.ones(len(out), bool)
            own[behind - 1] = False
            out[own] = B.span_hashes(text, starts, ends)
            parts.append(out)
            counts.append(n + 1)
        self.ids = rows.column("doc_id").to_pylist()
        self.n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        m, r = held_out_of or (1, 1)
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % m == r for i in self.ids], bool)
        trains = np.repeat(~self.held_out, self.n)
        head = self.first[:-1]
        before = np.empty(len(token), np.uint64)
        before[1:] = token[:-1]
        before[head] = BEGIN
        mixed = B.mix(token)
        pair = B.mix(before * MULTIPLIER ^ mixed)
        # The beginning is a word that no text holds; it counts the training documents.
        words, self.word = np.unique(np.append(token, BEGIN), return_inverse=True)
        self.begin, self.word = int(self.word[-1]), self.word[:-1].astype(np.int32)
        count = np.bincount(self.word[trains], minlength=len(words))
        count[self.begin] = int((~self.held_out).sum())
        self.words, self.word_count = words, count
        self.pairs, self.pair, self.pair_count = distinct(pair, trains)
        self.context = np.empty(len(token), np.int32)
        self.context[1:] = self.word[:-1]
        self.context[head] = self.begin
        # A triple stands at each token but a text's first; it is the pair before and the pair here.
        inner = np.ones(len(token), bool)
        inner[head] = False
        self.at = np.flatnonzero(inner)
        self.triples, self.triple, self.triple_count = distinct(B.mix(pair[self.at - 1] * MULTIPLIER ^ mixed[self.at]), trains[self.at])
        # One place of each pair and triple tells its parts.
        one = np.zeros(len(self.pairs), np.int64)
        one[self.pair] = np.arange(len(token))
        self.pair_from, self.pair_to = self.context[one], self.word[one]
        one = np.zeros(len(self.triples), np.int64)
        one[self.triple] = self.at
        self.triple_from, self.triple_to, self.triple_word = self.pair[one - 1], self.pair[one], self.word[one]

    def asked_triples(self, shared: np.ndarray) -> np.ndarray:
        """Triples that may occur in other blocks: both their pairs do."""
        return np.flatnonzero(shared[self.triple_from] & shared[self.triple_to])


def distinct(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's number, and counts in training documents."""
    found, number = np.unique(keys, return_inverse=True)
    return found, number.astype(np.int32), np.bincount(number[trains], minlength=len(found))


class Known:
    """What a block's tokens got answered in the first exchange."""

    def __init__(self, tokens: BlockTokens, n: int, buckets: list[int], bodies: list[bytes]):
        (words, shared_words, _), (pairs, shared_pairs, owner) = C.answered([tokens.words, tokens.pairs], n, buckets, bodies)
        self.word_total, self.pair_total = tokens.word_count + words, tokens.pair_count + pairs
        self.shared_words, self.asked = np.flatnonzero(shared_words), tokens.asked_triples(shared_pairs)
        # Different training pairs behind each word that this block is the first to hold.
        self.behind = np.bincount(tokens.pair_from[owner], minlength=len(tokens.words))
        # Pairs whose t() other blocks may add to; no state ends a text.
        some = shared_pairs & (self.pair_total > 1)
        if len(tokens.words):
            some &= tokens.words[tokens.pair_to] != END
        self.open_pairs = np.flatnonzero(some)

    def triples(self, tokens: BlockTokens, n: int, buckets: list[int], bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the second exchange answered: different pairs behind each word, each triple's count, and the different triples behind each pair that this block is the first to hold."""
        (behind, *_), (rest, _, owner) = C.answered([tokens.words[self.shared_words], tokens.triples[self.asked]], n, buckets, bodies)
        types, total, own = self.behind.copy(), tokens.triple_count.copy(), tokens.triple_count > 0
        types[self.shared_words] += behind
        total[self.asked] += rest
        own[self.asked] = owner
        return types, total, np.bincount(tokens.triple_from[own], minlength=len(tokens.pairs))


class Automaton:
    """States: the root, one for each word (the beginning too), one for each pair that doesn't end a text.

    An arc has the number of its n-gram: arcs of the root come first, by word; then those of
    words, by pair; then those of pairs, by triple. n-grams with a count above zero in
    ``word``, ``pair`` and ``triple`` have states and arcs; all words have arcs of the root.
    types, pair_types: t() of each word and of each pair.
    """

    def __init__(self, tokens: BlockTokens, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, types: np.ndarray, pair_types: np.ndarray, normal: int):
        n, end = len(word), np.searchsorted(tokens.words, END)
        self.begin, self.pairs_from = 1 + tokens.begin, 1 + n
        plain = (word + 1) / normal
        count = np.concatenate([[1], word, pair]).astype(np.float64)
        t = np.concatenate([[1], types, pair_types]).astype(np.float64)
        share = t / np.maximum(count + t, 1)
        self.failure = np.log10(np.where(share > 0, share, 1))
        self.fail_to = np.concatenate([np.zeros(1 + n, np.int64), 1 + tokens.pair_to])
        h, g = 1 + tokens.pair_from, 1 + n + tokens.triple_from
        of_pair = (pair + t[h] * plain[tokens.pair_to]) / np.maximum(count[h] + t[h], 1)
        of_triple = (triple + t[g] * of_pair[tokens.triple_to]) / np.maximum(count[g] + t[g], 1)
        self.has = np.concatenate([np.ones(n, bool), pair > 0, triple > 0])
        weight = np.concatenate([plain, of_pair, of_triple])
        self.weight = np.log10(np.where(self.has, weight, 1))
        # An arc leads to the state of the longest history that there is.
        word_state = np.where(word > 0, 1 + np.arange(n), 0)
        pair_state = np.where((pair > 0) & (tokens.pair_to != end), 1 + n + np.arange(len(pair)), 0)
        self.next = np.concatenate([word_state, pair_state, pair_state[tokens.triple_to]])

    def arcs(self, tokens: BlockTokens) -> np.ndarray:
        """The numbers of the arcs by each token: of the root, of a word and of a pair, if the text's own history leads there."""
        out = np.zeros((3, len(tokens.word)), np.int64)
        out[0], out[1] = tokens.word, len(tokens.words) + tokens.pair
        out[2, tokens.at] = len(tokens.words) + len(tokens.pairs) + tokens.triple
        return out

    def step(self, state: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each step by one of ``arcs``, failure arcs included, and the states after it."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            arc = arcs[(state > 0).astype(np.int8) + (state >= self.pairs_from), todo]
            has = self.has[arc]
            total[todo] += np.where(has, self.weight[arc], self.failure[state])
            after[todo[has]] = self.next[arc[has]]
            todo, state = todo[~has], self.fail_to[state[~has]]
        return total, after

    def traverse(self, arcs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight of each token of texts that begin at ``first`` (their end is the last of it).

        Texts go in lanes, one token of each at a step. A lane that begins amid a text takes the
        two tokens before it first, from the root: the state after them is that of the text.
        """
        n = np.diff(first)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lead = np.where(nth > 0, 2, 0)
        at = first[text] + nth * LANE - lead
        size = np.minimum(n[text] - nth * LANE, LANE) + lead
        order = np.argsort(-size, kind="stable")
        at, size, lead = at[order], size[order], lead[order]
        state = np.where(lead > 0, 0, self.begin)
        out = np.zeros(arcs.shape[1])
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t, "left"))
            weight, state = self.step(state[:m], arcs[:, at[:m] + t])
            counts = t >= lead[:m]
            out[at[:m][counts] + t] = weight[counts]
        return out


def scores(docs: DataFrame, held_out_of: tuple[int, int] | None = (7, 2), block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    held_out_of: modulus and remainder of crc32(doc_id as text) of the documents that don't
    train; None: all train.
    """
    table = blocks(with_key(docs), "model-blocks", block_bytes)
    n = bucket_count(table, bucket_bytes)
    many = table.count()
    keyed = dealt(table.select("block_id", "folder", "path"), "block_id", many, 4)

    def tokens_of(folder, path):
        return BlockTokens(read_block(folder, path), held_out_of)

    def ask(batches):
        for batch in batches:
            for block_id, folder, path in zip(*(batch.column(c).to_pylist() for c in ("block_id", "folder", "path"))):
                tokens = tokens_of(folder, path)
                yield C.requests(block_id, [(tokens.words, tokens.word_count), (tokens.pairs, tokens.pair_count)], n)
                del tokens
                B.give_back()

    def ask_again(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = tokens_of(left.column("folder")[0].as_py(), left.column("path")[0].as_py())
        known = Known(tokens, n, right.column("bucket").to_pylist(), right.column("body").to_pylist())
        some, asked = known.shared_words, known.asked
        out = C.requests(left.column("block_id")[0].as_py(), [(tokens.words[some], known.behind[some]), (tokens.triples[asked], tokens.triple_count[asked])], n)
        del tokens, known
        B.give_back()
        return pa.Table.from_batches([out])

    once = written(dealt(keyed.mapInArrow(ask, C.REQUEST), "bucket", n, 1).groupBy("bucket").applyInArrow(C.summed(int(BEGIN)), C.ANSWER), "model-counts")
    types, train_tokens = (int(x or 0) for x in once.agg(F.sum("types"), F.sum("tokens")).first())
    normal = train_tokens + types + 1
    first = once.select("block_id", "bucket", "body")
    twice = keyed.groupBy("block_id").cogroup(dealt(first, "block_id", many, 4).groupBy("block_id")).applyInArrow(ask_again, C.REQUEST)
    second = written(dealt(twice, "bucket", n, 1).groupBy("bucket").applyInArrow(C.summed(), C.ANSWER).select("block_id", "bucket", "body"), "model-triples")

    def turns(*tables: DataFrame) -> DataFrame:
        """The answers of several exchanges, by block."""
        every = None
        for turn, table in enumerate(tables):
            table = table.withColumn("turn", F.lit(turn))
            every = table if every is None else every.unionByName(table)
        return dealt(every, "block_id", many, 4).groupBy("block_id")

    def answers_of(right: pa.Table, number: int) -> list[tuple[list[int], list[bytes]]]:
        answers: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(number)]
        for turn, b, body in zip(*(right.column(c).to_pylist() for c in ("turn", "bucket", "body"))):
            answers[turn][0].append(b)
            answers[turn][1].append(body)
        return answers

    def ask_types(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = tokens_of(left.column("folder")[0].as_py(), left.column("path")[0].as_py())
        answers = answers_of(right, 2)
        known = Known(tokens, n, *answers[0])
        own = known.triples(tokens, n, *answers[1])[2]
        out = C.requests(left.column("block_id")[0].as_py(), [(tokens.pairs[known.open_pairs], own[known.open_pairs])], n)
        del tokens, known
        B.give_back()
        return pa.Table.from_batches([out])

    thrice = keyed.groupBy("block_id").cogroup(turns(first, second)).applyInArrow(ask_types, C.REQUEST)
    third = dealt(thrice, "bucket", n, 1).groupBy("bucket").applyInArrow(C.summed(), C.ANSWER).select("block_id", "bucket", "body")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = tokens_of(left.column("folder")[0].as_py(), left.column("path")[0].as_py())
        answers = answers_of(right, 3)
        known = Known(tokens, n, *answers[0])
        behind, triple, pair_types = known.triples(tokens, n, *answers[1])
        some = known.open_pairs
        pair_types[some] += C.answered([tokens.pairs[some]], n, *answers[2])[0][0]
        # A pair that training documents hold once is followed by one token, wherever that is.
        once_ = (known.pair_total == 1) & (tokens.words[tokens.pair_to] != END if len(tokens.words) else False)
        pair_types[once_] = 1
        automaton = Automaton(tokens, known.word_total, known.pair_total, triple, behind, pair_types, normal)
        weights = automaton.traverse(automaton.arcs(tokens), tokens.first)
        total = known.word_total[tokens.word]
        at = tokens.first[:-1]
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
        out = pa.table({"doc_id": pa.array(tokens.ids, pa.int64()), "held_out": pa.array(tokens.held_out), "n_tokens": pa.array(tokens.n), "n_known": pa.array(add((total > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(at), train_tokens)), "base_score": pa.array(add(np.log10((total + 1) / normal))), "score": pa.array(add(weights))})
        del tokens, known, automaton
        B.give_back()
        return out

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return keyed.groupBy("block_id").cogroup(turns(first, second, third)).applyInArrow(score, out)
