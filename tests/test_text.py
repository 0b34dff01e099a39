"""Functions and Markdown against plain models, and their edge cases."""

import itertools
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.tokenize import porter, query_terms
from quernstone.functions.vectors import from_blob, to_blob
from quernstone.operators import embed, hybrid, lexical, markdown, vector

WINDOWS = dict(most=40, overlap=10)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def check_windows(text, found, most, overlap):
    """What defines the windows: what they cover, how they overlap, where they may end."""
    if len(text) <= most:
        assert found == [text]
        return
    assert all(len(w) <= most for w in found)
    new = [found[0], *(w[min(overlap, len(v)) :] for v, w in zip(found, found[1:]))] if found else []
    assert all(w[: min(overlap, len(v))] == v[-overlap:] for v, w in zip(found, found[1:]))
    paragraphs = re.split(r"\n\n+", text)
    paragraphs = paragraphs[next((k for k, p in enumerate(paragraphs) if p), len(paragraphs)) :]
    whole = "\n\n".join(paragraphs)
    covered = "".join(new)
    # Nothing is lost but a blank end.
    assert whole.startswith(covered) and not whole[len(covered) :].strip()
    begins = list(itertools.accumulate((len(p) + 2 for p in paragraphs), initial=0))[:-1]
    ends = {b + len(p): k for k, (b, p) in enumerate(zip(begins, paragraphs))}
    for w, end in zip(found[:-1], itertools.accumulate(map(len, new))):
        if end in ends and ends[end] + 1 < len(paragraphs):
            assert len(w) == most or len(w) + 2 + len(paragraphs[ends[end] + 1]) > most
        else:
            # A cut amid a paragraph: the window is full, and the paragraph doesn't fit behind the overlap either.
            k = max(k for k, b in enumerate(begins) if b <= end)
            assert len(w) == most and (begins[k] + len(paragraphs[k]) - (end - len(w)) > most)


def test_windows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bc ", "d", "\n\n", "\n", "é", "😀"]) for _ in range(rng.randint(0, 150))) for _ in range(300)] + ["x" * 40, "x" * 41, "x" * 70, "x" * 100]
    got = values(spark, [(t,) for t in texts], "t string", markdown.windows(F.col("t"), **WINDOWS))
    for t, found in zip(texts, got):
        check_windows(t, found, **WINDOWS)
    # One paragraph: offsets in steps of what doesn't overlap.
    for n in (40, 41, 70, 71, 100, 101):
        one = "".join(chr(0x100 + i) for i in range(n))
        starts = range(0, max(n - 40, 0) + 30, 30) if n > 40 else [0]
        assert values(spark, [(one,)], "t string", markdown.windows(F.col("t"), **WINDOWS))[0] == [one[i : i + 40] for i in starts if i == 0 or i + 10 < n]


def sections_between_headings(body):
    """(heading, text) of what stands between heading lines, by their places."""
    lines = body.split("\n")
    at = [i for i, line in enumerate(lines) if re.match(r"#{1,3}\s", line)]
    found = [("" if a < 0 else lines[a].lstrip("#").strip(), "\n".join(lines[a + 1 : b]).strip()) for a, b in zip([-1, *at], [*at, len(lines)])]
    return [s for s in found if any(s)]


def test_sections_lie_between_headings(spark):
    rng = random.Random(2)
    bodies = ["".join(rng.choice(["# ", "## a", "### b c", "#### d", "\n", "\n", "x", " ", "\t#", "# \t y", "```"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = values(spark, [(b,) for b in bodies], "t string", markdown.sections(F.col("t")))
    assert [[tuple(s) for s in g] for g in got] == [sections_between_headings(b) for b in bodies]


FRONT = [
    ("---\ntitle: A\nbreadcrumb:\n - x\n - yes\n - true\n - 1.50\n---\nbody", ("A", "x > yes > True > 1.5"), "body"),
    ("---\ntitle: A\n", ("", ""), "---\ntitle: A\n"),
    ("﻿---\ntitle: A\n---\nb", ("", ""), "﻿---\ntitle: A\n---\nb"),
    ("---\njust text\n---\nb", ("", ""), "b"),
    ("---\ntitle: A\ntitle: B\n---\nb", ("", ""), "---\ntitle: A\ntitle: B\n---\nb"),
    ("---\ntitle: [\n---\nb", ("", ""), "---\ntitle: [\n---\nb"),
    ("---\ntitle: ~\nbreadcrumb: 'true'\n---\n\n\nb", ("", "true"), "b"),
    ("no front", ("", ""), "no front"),
]


def test_frontmatter(spark):
    rows = markdown.parse_docs(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(FRONT)], "i int, content string")).orderBy("i").collect()
    for row, (_, meta, body) in zip(rows, FRONT):
        assert (row["meta"]["title"], row["meta"]["breadcrumb"]) == meta
        assert row["body"].lstrip("\n") == body


def test_chunks_of_a_document(spark):
    text = "---\ntitle: T\nbreadcrumb: [a, b]\n---\nlead\n# One, two!\ntext\n#### deep\n## Empty\n"
    rows = markdown.with_ids(markdown.chunk_docs(spark.createDataFrame([("r", "p.md", text)], "release string, path string, content string"))).orderBy("id").collect()
    assert [(r["id"], r["heading"], r["anchor"], r["content"]) for r in rows] == [(1, "", "", "lead"), (2, "One, two!", "one-two", "text\n#### deep"), (3, "Empty", "empty", "")]


@pytest.mark.parametrize(
    ("source", "path", "release"),
    [
        ("https://h/docs/r/v1/a/b.html", "a/b.md", "v1"), ("https://h/x/y", "x/y.md", None), ("/markdown/v1/a.md", "a.md", "v1"), ("v1", "v1.md", None),
        ("V1/a", "V1/a.md", None), ("  a/b.md ", "a/b.md", None), ("https://h/docs/", "", None), ("a#b", "a#b.md", None), ("", "", None),
    ],
)
def test_repo_path(spark, source, path, release):
    row = spark.range(1).select(T.repo_path(F.lit(source), ["v1", "v2"]).alias("p")).first()["p"]
    assert (row["repo_path"], row["release_in_path"]) == (path, release)


def test_unicode_trim_slug_and_terms(spark):
    row = spark.range(1).select(T.trim_ws(F.lit(" \n a b \t")), T.slug(F.lit(" Été à  la_mode! ")), query_terms(F.lit("Café a B2 b2 x_y")), T.snippet(F.lit("a\n\nb" + "c" * 300))).first()
    assert row[0] == "a b" and row[1] == "été-à-la_mode" and row[2] == ["caf", "b2"] and len(row[3]) == 240


def test_porter_and_bm25_equal_sqlite(spark):
    docs = ["running runners ran quickly relational conditional", "the hopping hoped hopes happily", "motoring motors national rationalization", "sky skies flying flies dying", "runner and sky café controlling"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, title, breadcrumb, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, content, title, breadcrumb) values (?, ?, 'T', 'en')", list(enumerate(docs, 1)))
    db.execute("create virtual table v using fts5vocab(f, 'row')")
    vocabulary = {t for (t,) in db.execute("select term from v")}
    words = {w for d in docs for w in d.replace("é", "e").split()} | {"t", "en"}
    assert {porter(w) for w in words} == vocabulary
    chunks = spark.createDataFrame([(i, d, "T", "en") for i, d in enumerate(docs, 1)], "id long, content string, title string, breadcrumb string")
    queries = ["runner sky", "hope hoping motor", "national", "query queries flies fly"]
    found = lexical.bm25(lexical.build(chunks), spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), 10).collect()
    for n, q in enumerate(queries):
        want = db.execute("select rowid, rank from f where f match ? order by rank, rowid", (" OR ".join(f'"{w}"' for w in q.split()),)).fetchall()
        got = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == n)
        assert [g[1] for g in got] == [w[0] for w in want]
        assert all(abs(g[2] - w[1]) < 1e-9 for g, w in zip(got, want))


def test_fusion_order_and_limits(spark):
    lex = spark.createDataFrame([(0, 10, 0), (0, 11, 1)], "query_id int, id long, rank int")
    vec = spark.createDataFrame([(0, 12, 0), (0, 11, 1)], "query_id int, id long, rank int")
    rows = hybrid.fuse(lex, vec).orderBy(F.desc("score"), "position").collect()
    assert [r["id"] for r in rows] == [11, 10, 12]
    assert hybrid.pool_size(0) == 40 and hybrid.pool_size(11) == 44 and hybrid.pool_size(-3) == 40


def test_knn_batch_equals_single(spark):
    rows = [(i, [float(x) for x in embed.HashingEmbedder(8).embed([f"w{i % 7} v{i}"])[0]]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    batch = vector.knn(vectors, spark.createDataFrame(rows[:5], "query_id long, embedding array<float>"), 6).collect()
    for q, v in rows[:5]:
        single = [r["id"] for r in vector.nearest(vectors, v, 6).collect()]
        assert [r["id"] for r in sorted((r for r in batch if r["query_id"] == q), key=lambda r: r["rank"])] == single


def test_knn_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 17), float(i % 5), 1.0]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = spark.createDataFrame(rows[::3], "query_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in vector.knn(vectors, asked, 4).collect())
    # Ties at the edge go to the smaller id, whatever the blocks.
    plain = {q: sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for i, w in rows)[:4] for q, v in rows[::3]}
    assert {(q, i): d for q, i, d, _ in whole} == {(q, i): pytest.approx(d) for q, found in plain.items() for d, i in found}
    for name, size in (("QUERIES", 7), ("VECTORS", 5)):
        monkeypatch.setattr(vector, name, size)
    assert sorted(tuple(r) for r in vector.knn(vectors, asked, 4).collect()) == whole
    assert vector.knn(vectors, asked.where("false"), 4).count() == vector.knn(vectors.where("false"), asked, 4).count() == 0
    with pytest.raises(Exception, match="components"):
        vector.knn(vectors, spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<float>"), 4).collect()


def test_table_embedder(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "red": 1, "blue": 2, "sky": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    np.save(tmp_path / "vectors.npy", np.array([[0, 0, 1], [3, 0, 0], [0, 4, 0], [1, 1, 0]], np.float32))
    made = embed.load(str(tmp_path))
    assert made.dim == 3
    # The mean of the tokens' vectors, of unit length; no tokens, no direction.
    assert made.embed(["red blue", "sky", "", "green"]) == pytest.approx(np.array([[0.6, 0.8, 0], [0.5**0.5, 0.5**0.5, 0], [0, 0, 0], [0, 0, 1]]), abs=1e-6)
    got = values(spark, [("red red",), (None,)], "t string", embed.passages(F.col("t"), str(tmp_path)))
    assert got == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]] and embed.query("blue", str(tmp_path)) == [0.0, 1.0, 0.0]
    # The same vectors as a table are joined and pooled natively.
    assert embed.info(spark, str(tmp_path)) == (tmp_path.name, 3)
    table = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(made.table)], "token int, embedding array<float>")
    table.write.parquet(str(tmp_path / "vectors.parquet"))
    texts = ["red blue", "sky", "", "green", None, "sky red sky"]
    pooled = embed.embedded(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), str(tmp_path))
    got = {r["id"]: r["embedding"] for r in pooled.collect()}
    assert [got[i] for i in range(6)] == [pytest.approx(x, abs=1e-6) for x in made.embed([t or "" for t in texts])]
    assert embed.query("blue", str(tmp_path), spark) == [0.0, 1.0, 0.0] and embed.info(spark, str(tmp_path))[1] == 3


def test_blob_round_trip():
    assert from_blob(to_blob([1.0, -0.5])) == [1.0, -0.5]
