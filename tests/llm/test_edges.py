"""Nulls, empty and long texts, repeated rows, ties, empty tables, extra columns with clashing names."""

import numpy as np
import pytest

from quernstone.llm import decontaminate, language_model, licences, neighbours, packing, quality, repeats, simhash, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, label int, score double, fp long, block_id long, body string, key string, _id int"
LONG = "word " * 60_000 + "x" * 50_000
TEXTS = [(1, "a b c d"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (6, LONG), (None, "no id here at all"), (None, None), (7, "é 😀 ünï   x"), (7, "another text of the same id"), (8, "a b c d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "b", "k", 3) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def both(spark):
    """Labels of both kinds, so that the classifiers are trained."""
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 9)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OPERATORS = {
    "toxicity": lambda d, m: toxicity.toxicity(d, toxicity.train(d, m)),
    "token files": lambda d, m: token_files.round_trip(d, word_file(), 1),
    "quality": lambda d, m: quality.quality(d, quality.train(d, m)),
    "language model": lambda d, m: language_model.scores(d),
    "repeats": lambda d, m: repeats.digests(d),
    "spans": lambda d, m: repeats.removed_spans(d),
    "cut": lambda d, m: repeats.without_repeats(d),
    "decontamination": lambda d, m: decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text")),
    "licences": lambda d, m: licences.licences(d),
    "near-duplicates": lambda d, m: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((i is not None, i or 0) for i, _ in TEXTS)


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_trained_scorers(docs, empty, both, name):
    rows = OPERATORS[name](docs, both).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert OPERATORS[name](empty, both).count() == 0
    model = (toxicity if name == "toxicity" else quality).train(docs, both)
    assert (model.trees if name == "toxicity" else model.factors) is not None


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels).count() == 0


def test_filters_keep_columns(docs, empty, labels):
    model = quality.train(docs, labels)
    items = docs.where("doc_id = 1").selectExpr("doc_id as item_id", "text")
    for d in (docs, empty):
        for kept in (quality.good_documents(d, model), simhash.one_of_each(d), repeats.without_repeats(d), decontaminate.clean_documents(d, items)):
            assert kept.columns == d.columns and kept.count() <= d.count()
    assert decontaminate.clean_documents(docs, items).where("doc_id in (1, 8)").count() == 0


def test_defined_results(docs):
    near = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    zero = "0" * 16
    assert near[2, zero] == near[3, zero] == near[4, zero] == near[None, zero] == 2
    assert {c for (i, _), c in near.items() if i == 8} == {1}
    cut = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.digests(docs).collect()}
    assert cut[2, 0] == 0 and cut[6, len(LONG)] == len(LONG) and 0 < cut[5, len(LONG)] < len(LONG)


def test_packing_edges(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, keep_ids=True).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS} and all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack_documents(empty, path).count() == 0


VECTORS = [(i, [float(i % 5), 1.0, 0.5 * (i % 3)]) for i in range(1, 61)] + [(None, [1.0, 1.0, 1.0]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [float("nan"), 1.0, 1.0]), (64, [1.0, None, 1.0]), (65, [1.0, 2.0]), (20, [9.0, 9.0, 9.0]), (80, [float("inf"), 0.0, 0.0])]


def test_neighbours_edges(spark):
    schema = "vec_id long, embedding array<float>, id string, leaf int, score int"
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in VECTORS], schema)
    rows = neighbours.nearest(table, 20, "vec_id", "embedding", k=20).collect()
    assert {r["query_id"] for r in rows} == {20, 40, 60}
    for q in (20, 40, 60):
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and len({r["vec_id"] for r in mine}) == 20 and q not in {r["vec_id"] for r in mine}
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
    few = neighbours.nearest(table.where("vec_id in (20, 21)"), 20, "vec_id", "embedding").collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(20, 21)}
    assert neighbours.nearest(table.where("false"), 20, "vec_id", "embedding").count() == 0


def test_rows_without_id_link_by_fingerprint_alone(spark):
    first, second = "alpha beta gamma delta epsilon", "one two three four five six"
    rows = [(None, first), (None, second), (4, first), (9, second), (None, "nobody else says any of this")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted([(None, 4), (None, 9), (4, 4), (9, 9), (None, None)], key=str)


def test_one_row_of_each_component_stays(spark):
    first, second, third = "alpha beta gamma delta epsilon", "one two three four five six", "nobody else says any of this here"
    rows = [(None, first, 1), (None, second, 2), (4, first, 3), (4, first, 4), (9, first, 5), (None, second, 6), (5, third, 7), (5, "other words of the same id", 8), (6, third, 9), (None, "alone and without id", 10)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _copy int"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert kept.columns == ["doc_id", "text", "_copy"] and len(got) == 4
    assert {(i, t) for i, t in got} >= {(None, second), (4, first), (None, "alone and without id")} and [i for i, _ in got if i == 5] == [5]


def test_common_fingerprints_meet_as_rare_ones(spark, monkeypatch):
    rows = [(i, f"text number {i // 7} of this many" if i % 3 else "the same for all") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for often in (1, 4, 1 << 20):
        monkeypatch.setattr(simhash, "OFTEN", often)
        found.append(sorted(simhash.near_duplicates(docs).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 200


def test_trie_in_parts_finds_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    groups = [np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64) << np.uint64(k)) for k in (0, 20, 54)]
    fps, cuts = np.concatenate(groups), np.cumsum([0, *map(len, groups)])
    want = {(a, b) for s, e in zip(cuts[:-1], cuts[1:]) for a in range(s, e) for b in range(a + 1, e) if bin(int(fps[a]) ^ int(fps[b])).count("1") <= 2}
    for most in (1, 7, 1 << 21):
        monkeypatch.setattr(simhash, "PAIRS", most)
        parts = list(simhash.trie_pairs(fps, cuts, 2))
        assert {(min(i, j), max(i, j)) for a, b in parts for i, j in zip(a.tolist(), b.tolist())} == want and (len(parts) > 50) == (most < 10)


def test_doc_ids_beyond_the_range_are_an_error(spark):
    with pytest.raises(ValueError, match="span"):
        simhash.near_duplicates(spark.createDataFrame([(1 << 62, "a b c"), (-(1 << 62), "a b c")], "doc_id long, text string")).collect()
    wide = [((1 << 63) - 1, "a b c"), (1 << 62, "a b c"), (3, "d e f"), (None, "a b c"), (None, "x y z")]
    got = simhash.near_duplicates(spark.createDataFrame(wide, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([((1 << 63) - 1, 1 << 62), (1 << 62, 1 << 62), (3, 3), (None, 1 << 62), (None, None)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(spark.createDataFrame(wide, "doc_id long, text string")).collect()), key=str) == sorted([(1 << 62, "a b c"), (3, "d e f"), (None, "x y z")], key=str)


def test_unset_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from quernstone import shared

    class Cluster:
        conf = {}

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.session_folder(Cluster())
