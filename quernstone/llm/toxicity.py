"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of lexicons (a fixed list of insults, and the words and word beginnings
that mark toxic documents among the training rows), how near second-person words stand, rates of
capitals, punctuation and obfuscation (letters replaced by digits or signs, letters
stretched), and sizes. A training row's own features come from a lexicon learnt without its
fold. Histogram-based trees fit the logistic loss by Newton steps on all folds but one; the
last calibrates their sum by isotonic regression.

The classifier is trained on the driver over a bounded sample of labelled rows (``rows``); the
learnt lexicon is part of it and has 2000 words and 2000 word beginnings at most (``most``).
Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts have all features zero and get the score of that;
rows without doc_id are scored and count as not held out; without labelled rows of both
kinds every score is the share of label 1 (0.5 if there are none); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm import _bytes as B
from quernstone.llm._store import with_key
from quernstone.llm.labelled import held_out, sample

# Insults of four languages.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb dumbass fool
jerk creep freak imbecile cretin bastard bitch asshole arsehole shit bullshit fuck fucking fucker cunt dickhead twat wanker prick slut whore retard
retarded degenerate vermin filth filthy parasite parasites subhuman coward liar hate kill
dumm dummkopf trottel arschloch scheisse scheiße hurensohn wichser depp vollidiot abschaum versager blödmann fotze schlampe
connard connasse salaud salope merde putain abruti crétin débile enculé ordure raclure minable pourriture
idiota imbécil estúpido estúpida gilipollas cabrón puta mierda pendejo basura escoria inútil asqueroso perdedor
""".split()
# Words of the second person in four languages, but for those that are common words or syllables in another.
SECOND_PERSON = "you your yours yourself youre ur du dich dir dein deine euch tu toi vous votre usted ustedes tú contigo vosotros".split()
# Letters that digits and signs stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Bytes of a word's beginning.
STEM = 5
NAMES = ("words", "length", "insults", "any_insult", "marked", "any_marked", "marked_stems", "any_marked_stem", "you", "insults_near_you", "capitals", "shouted", "punctuation", "exclamations", "digits", "obfuscated", "hidden_insults", "stretched")

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SIGN = LETTER.copy()
SIGN[[ord(c) for c in "0123456789@$!*"]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
TO_LETTER = B.LOWER.copy()
for _sign, _letter in LEET.items():
    TO_LETTER[ord(_sign)] = ord(_letter)


def hashes_of(texts: list[str]) -> np.ndarray:
    """Sorted hashes of words, as span_hashes() gives them."""
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    return np.unique(B.span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)) if data else np.zeros(0, np.uint64)


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


_INSULTS, _YOU = hashes_of(INSULTS), hashes_of(SECOND_PERSON)


Lexicon = tuple[np.ndarray, np.ndarray]
NO_LEXICON: Lexicon = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, near: int = 3) -> np.ndarray:
    """One row of NAMES for each text. lexicon: sorted hashes of learnt words and stems."""
    return np.concatenate([_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lexicon, near) for i, j in B.slices(offsets)] or [np.zeros((0, len(NAMES)))])


def _features(buf: np.ndarray, at: np.ndarray, lexicon: Lexicon, near: int) -> np.ndarray:
    size = np.maximum(np.diff(at), 1)
    text = B.LOWER[buf]
    starts, ends, first = B.words(text, at, ~LETTER)
    word = B.span_hashes(text, starts, ends)
    n = np.diff(first)
    many = np.maximum(n, 1)
    insult, you, mark = among(word, _INSULTS), among(word, _YOU), among(word, lexicon[0])
    stem = among(B.span_hashes(text, starts, np.minimum(starts + STEM, ends)), lexicon[1])
    # Insults with a second-person word at most ``near`` words away, within their row.
    row = np.repeat(np.arange(len(n)), n)
    places = np.flatnonzero(you)
    close = np.zeros(len(word), bool)
    hit = np.flatnonzero(insult | mark)
    if len(places) and len(hit):
        for k in (0, -1):
            p = places[np.clip(np.searchsorted(places, hit) + k, 0, len(places) - 1)]
            close[hit] |= (np.abs(p - hit) <= near) & (row[p] == row[hit])
    capital = (buf >= 65) & (buf <= 90)
    caps = np.concatenate([[0], np.cumsum(capital, dtype=np.int64)])
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    punctuation, digit, exclamation = PUNCTUATION[buf], (buf >= 48) & (buf <= 57), buf == 33
    # Words in which digits or signs stand among letters, read as the letters they stand for.
    s2, e2, f2 = B.words(buf, at, ~SIGN)
    letters = np.concatenate([[0], np.cumsum(LETTER[buf], dtype=np.int64)])
    own = letters[e2] - letters[s2]
    mixed = (own > 0) & (own < e2 - s2) & LETTER[buf[s2]] & (LETTER[buf[e2 - 1]] if len(e2) else np.zeros(0, bool))
    read = TO_LETTER[buf]
    hidden = np.zeros(len(s2), bool)
    some = np.flatnonzero(mixed)
    hidden[some] = among(B.span_hashes(read, s2[some], e2[some]), _INSULTS)
    same = np.zeros(len(buf), bool)
    if len(buf) > 2:
        same[2:] = (text[2:] == text[1:-1]) & (text[2:] == text[:-2]) & LETTER[text[2:]]
        for k in (0, 1):  # a run of letters doesn't go on from the text before
            same[np.minimum(at[:-1] + k, len(buf) - 1)] = False
    by_word = lambda x: sums(x, first)
    by_byte = lambda x: sums(x, at)
    return np.stack(
        [
            np.log1p(n), np.log1p(np.diff(at)), by_word(insult) / many, np.log1p(by_word(insult)), by_word(mark) / many, np.log1p(by_word(mark)), by_word(stem) / many, np.log1p(by_word(stem)), by_word(you) / many,
            np.log1p(by_word(close)), by_byte(capital) / size, by_word(shouted) / many, by_byte(punctuation) / size, by_byte(exclamation) / size, by_byte(digit) / size,
            sums(mixed, f2) / many, np.log1p(sums(hidden, f2)), by_byte(same) / size,
        ],
        axis=1,
    )


class Marks:
    """In which labelled documents each word stands; learns the words that mark toxic ones."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, stem: int | None = None):
        words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in B.slices(offsets):
            text, at = B.LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = B.words(text, at, ~LETTER)
            word = B.span_hashes(text, starts, ends if stem is None else np.minimum(starts + stem, ends))
            row = np.repeat(np.arange(i, j), np.diff(first))
            order = np.lexsort((word, row))
            word, row = word[order], row[order]
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])]) if len(word) else np.zeros(0, bool)
            words.append(word[new])
            rows.append(row[new])
        self.row = np.concatenate(rows).astype(np.int32)
        self.distinct, word = np.unique(np.concatenate(words), return_inverse=True)
        self.word = word.astype(np.int32)

    def learn(self, label: np.ndarray, rows: np.ndarray, least: int = 4, rate: float = 0.75, most: int = 2000) -> np.ndarray:
        """Sorted hashes of words found in ``least`` toxic documents of ``rows`` or more, ``rate`` of all they stand in."""
        inside = rows[self.row]
        toxic = np.bincount(self.word[inside], label[self.row[inside]], len(self.distinct))
        every = np.bincount(self.word[inside], minlength=len(self.distinct))
        good = np.flatnonzero((toxic >= least) & ((toxic + 0.1) / (every + 1) >= rate))
        return np.sort(self.distinct[good[np.argsort(-toxic[good], kind="stable")][:most]])


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, total = np.log(p / (1 - p)), np.full(n, np.log(p / (1 - p)))
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-total))
            g, h = q - y, q * (1 - q)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            node = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, width = 2**level - 1, 2**level
                at = node - first
                live = at >= 0
                G, H = np.bincount(at[live], g[live], width), np.bincount(at[live], h[live], width)
                value[first : first + width] = -G / (H + self.ridge)
                if level == self.depth:
                    break
                gain, best_f, best_c = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
                for j in range(d):
                    key = at[live] * self.bins + binned[live, j]
                    gs = np.bincount(key, g[live], width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h[live], width * self.bins).reshape(width, -1).cumsum(1)
                    gr, hr = G[:, None] - gs, H[:, None] - hs
                    won = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - (G**2 / (H + self.ridge))[:, None]
                    won[(hs * 4 < self.least) | (hr * 4 < self.least)] = -np.inf
                    c = won.argmax(1)
                    w = won[np.arange(width), c]
                    better = w > gain
                    gain[better], best_f[better], best_c[better] = w[better], j, c[better]
                feature[first : first + width], cut[first : first + width] = best_f, best_c
                split = live & (best_f[np.where(live, at, 0)] >= 0)
                right = binned[np.arange(n), np.where(split, best_f[np.where(live, at, 0)], 0)] > best_c[np.where(live, at, 0)]
                leaf = live & ~split
                total[leaf] += self.rate * value[node[leaf]]
                node = np.where(split, 2 * node + 1 + right, -1)
            done = node >= 0
            total[done] += self.rate * value[node[done]]
            self.nodes.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The sum before calibration."""
        binned, row = self._binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (binned[row, np.maximum(f, 0)] > cut[node]), node)
            total += self.rate * value[node]
        return total


def isotonic(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling adjacent violators, each pool drawn to the middle by ``weight``."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][2] += t
    mean = y.mean() if len(y) else 0.5
    s, n, t = np.array(pools).T if pools else (np.array([0.0]), np.array([1.0]), np.array([0.0]))
    return t / n, np.maximum.accumulate((s + weight * mean) / (n + weight))


class Model:
    """The learnt lexicon, trees and calibration."""

    FOLDS = 5

    def __init__(self, texts: pa.Array, label: np.ndarray):
        n = len(label)
        self.share = float(label.mean()) if n else 0.5
        self.lexicon, self.trees = NO_LEXICON, None
        if not 0 < label.sum() < n:
            return
        fold = np.arange(n) % self.FOLDS
        buf, offsets = B.column_bytes(texts)
        marks = [Marks(buf, offsets), Marks(buf, offsets, STEM)]
        x = np.zeros((n, len(NAMES)))
        for f in range(self.FOLDS):
            lexicon = tuple(m.learn(label, fold != f) for m in marks)
            x[fold == f] = features(*B.column_bytes(texts.take(pa.array(np.flatnonzero(fold == f)))), lexicon)
        self.lexicon = tuple(m.learn(label, fold >= 0) for m in marks)
        last = fold == self.FOLDS - 1
        if not 0 < label[last].sum() < last.sum() or not 0 < label[~last].sum() < (~last).sum():
            last = fold >= 0  # too few rows to set some aside
        fitted = ~last if not last.all() else last
        self.trees = Trees().fit(x[fitted], label[fitted])
        self.knots = isotonic(self.trees.predict(x[last]), label[last])
        B.give_back()

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        return np.clip(np.interp(self.trees.predict(features(buf, offsets, self.lexicon)), *self.knots), 0, 1)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, rows: int = 10_000) -> Model:
    """A model of label 1 of ``toxic`` from ``rows`` labelled rows at most that aren't held out."""
    table = sample(docs, labels, "toxic", modulus, remainder, rows).select("doc_id", "text", "label").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    order = np.random.default_rng(1).permutation(table.num_rows)
    table = table.take(pa.array(order))
    return Model(table.column("text").combine_chunks(), table.column("label").to_numpy().astype(np.float64))


def toxicity(docs: DataFrame, model: Model, modulus: int = 4, remainder: int = 2, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            score = model.scores(*B.column_bytes(batch.column("text")))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": pa.array(held_out(ids.to_pylist(), modulus, remainder)), "score": pa.array(score), "predicted": pa.array((score >= cut).astype(np.int32))})
        B.give_back()

    return with_key(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
