"""Source divergence against plain Python with whole numbers of any size."""

import collections
import re

import numpy as np
import pyarrow as pa

from quernstone.llm.divergence import Block, counted, divergence, share

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {65 + i: 97 + i for i in range(26)}


def plain(rows: list[tuple], least: int, top: int) -> set[tuple]:
    count, docs = collections.Counter(), collections.Counter()
    groups = sorted({(lang or "", source or "") for _, _, lang, source in rows})
    for _, text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOW))
        docs.update((lang or "", t) for t in set(found))
        count.update((lang or "", source or "", t) for t in found)
    out = set()
    for lang in {g[0] for g in groups}:
        terms = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=str.encode)
        sources = [s for x, s in groups if x == lang]
        total = {s: sum(count[lang, s, t] for t in terms) for s in sources}
        p = {s: [1 + 10**9 * (count[lang, s, t] + 2) // (total[s] + 2 * len(terms)) for t in terms] for s in sources}
        q = [1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(terms)) for t in terms]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            firsts = [(-f(a, b), t.encode(), t) for t, a, b in zip(terms, p[s], q) if count[lang, s, t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", firsts, top)):
                out |= {(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:most])}
    return out


def rows_of(n: int = 240) -> list[tuple]:
    rng = np.random.default_rng(3)
    letters = ["a", "B", "é", "Ω", "zz", "Long", "x" * 9, "x" * 8 + "y", "y" * 40, "語"]
    rows = []
    for i in range(n):
        words = rng.choice(letters, rng.integers(0, 30)).tolist() + rng.choice(letters, 3).tolist()
        text = "".join(w + str(rng.choice([" ", "-", "1", "\n", "", "@", "["])) for w in words)
        # A third of all rows and more is one source of one language.
        lang, source = ("en", "hot") if i % 2 else (str(rng.choice(["en", "de", "é"])), f"s{rng.integers(0, 5)}")
        rows.append((i, text, lang, source))
    return rows + [(1, rows[1][1], "en", "hot"), (n, None, "en", "none"), (n + 1, "", None, None), (n + 2, "only once", "xx", "a"), (n + 3, "once", "xx", "b"), (None, "12 34", "yy", "a"), (None, "w " * 5000, "en", None)]


def test_equals_plain_python(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, source string, n long, term string").repartition(5)
    for least, top, chunk, cells in ((10, 10, 1 << 20, 1 << 18), (3, 2, 300, 4)):
        got = {tuple(r) for r in divergence(docs, least, top, chunk, cells).collect()}
        assert got == plain(rows, least, top)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence(docs).collect() == []
    one = spark.createDataFrame([(1, None, None, None), (2, "a b", None, "s")], docs.schema)
    assert {tuple(r) for r in divergence(one).collect()} == {("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)}


def test_equal_hashes_are_told_apart():
    rows = rows_of(60)
    table = pa.table({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] or "" for r in rows]})
    good = counted(table)
    for weak in (lambda b: len(b) % 3, lambda b: 7, lambda b: b[0]):
        assert sorted(map(str, counted(table, weak).to_pylist())) == sorted(map(str, good.to_pylist()))
    want = collections.Counter((r[2] or "", r[3] or "", t) for r in rows for t in TERM.findall((r[1] or "").translate(LOW)))
    assert {(x["lang"], x["source"], x["term"]): x["n"] for x in good.to_pylist()} == want


def test_names_that_join_to_the_same_text():
    table = pa.table({"lang": ["1:a", "1"], "source": ["b", "a:b"], "text": ["x", "x"]})
    assert [tuple(x.values()) for x in counted(table).to_pylist()] in ([("1:a", "b", "x", 1, 1), ("1", "a:b", "x", 1, 1)], [("1", "a:b", "x", 1, 1), ("1:a", "b", "x", 1, 1)])


def test_large_counts_divide_exactly():
    n, c = 4 * 10**15, [0, 1, 3 * 10**15, 4 * 10**15]
    assert share(np.array(c), np.full(4, n), 7).tolist() == [1 + 10**9 * (x + 2) // (n + 14) for x in c]
    # A term that no source but one has, among four sources.
    block = Block(pa.array(["t"]), np.array([0, 1]), np.array([2]), np.array([5]), np.array([9, 0, 5, 1]), 15, 3)
    p = [1 + 10**9 * (x + 2) // (y + 6) for x, y in ((0, 9), (0, 0), (5, 5), (0, 1))]
    assert block.pairs().tolist() == [[(a - b) ** 2 // (a + b) for b in p] for a in p]
