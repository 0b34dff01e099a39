"""Personal data against the stated expressions in plain Python, with checksums of known numbers."""

import hashlib
import random
import re

import duckdb
import pytest

from quernstone.llm import personal as P
from quernstone.llm.personal_sql import OP12_SQL

SCHEMA = "doc_id long, text string"


def luhn(number: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def base_of(text: str, kinds: set = frozenset(P.BASE)) -> list[tuple]:
    """(start, kind, end) of the base by the expressions as they are stated."""
    number = lambda m: re.sub("[^0-9]", "", m)
    good = {
        "email": (P.EMAIL, lambda m: True), "ip": (P.IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (P.CARD, lambda m: 14 <= len(number(m)) <= 19 and luhn(number(m))), "phone": (P.PHONE, lambda m: 10 <= len(number(m)) <= 15),
    }
    found = [(m.start(), k, m.end()) for k, (p, ok) in good.items() if k in kinds for m in re.finditer(p, text) if ok(m.group())]
    return sorted(found, key=lambda s: (s[0], P.KINDS.index(s[1])))


def texts() -> list[str]:
    rng = random.Random(5)
    bits = ["a", "Z", "é", "😀", "@", ".", "_", "-", "%", "+", "1", "0", "25", "255", "256", " ", "  ", "(", ")", "\n", "4111 1111 1111 1111", "+1 (377) 555-0271", "x@y.zz", "10.0.0.1", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "ssn ", "tel ", "version ", "iban: ", "030 1234567"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    made += ["".join(rng.choice("0123456789 -.") for _ in range(60)) for _ in range(300)]
    made += ["".join(rng.choice("a@.-_b") for _ in range(40)) for _ in range(300)]
    return made


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, {r["doc_id"]: r for r in P.digests(docs).collect()}


def test_base_equals_stated_expressions(found):
    rows, got = found
    kinds = set()
    for i, text in rows:
        base = base_of(text)
        kinds |= {k for _, k, _ in base}
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, joined, r["spans"])
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(b[1] == k for b in base) for k in P.BASE]
        kept = [x for x in r["spans"].split(",") if x.split(":")[0] in P.BASE]
        assert ",".join(kept) == joined
    assert kinds == set(P.BASE)


def test_added_never_overlap_but_ibans(found):
    rows, got = found
    added = 0
    for i, text in rows:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        assert len(got[i]["scores"].split(",")) == max(1, len(spans))
        for k, s, e in spans:
            if k in ("ssn", "national"):
                added += 1
                assert not any(a < e and s < b for j, a, b in spans if (j, a, b) != (k, s, e) and j != "iban"), (text, spans)
    assert added > 3


def test_equals_sql(found):
    rows, got = found
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    want = c.sql(OP12_SQL).df().set_index("doc_id")
    assert {i: tuple(r[x] for x in want.columns) for i, r in got.items()} == {i: tuple(r) for i, r in zip(want.index, want.itertuples(index=False))}


@pytest.mark.parametrize(
    ("text", "spans", "scores"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 X", "iban:5:32", "100"),
        ("DE89 3704 0044 0532 0130 00", "iban:0:27", "85"),
        ("DE88 3704 0044 0532 0130 00", "", ""),
        ("xDE89370400440532013000", "", ""),
        ("DE893704004405320130001", "", ""),
        ("His social security number: 123-45-6789.", "ssn:28:39", "70"),
        ("Part 123-45-6789.", "", ""),
        ("ssn 666-45-6789", "", ""),
        ("Tel 030 1234567, 2024-01-15", "national:4:15", "65"),
        ("version 1.2.3.4", "ip:8:15", "20"),
        ("server 1.2.3.4", "ip:7:14", "95"),
        ("a@b.c_d@e.f", "email:0:5,email:5:11", "90,90"),
        ("256.1.1.1 0000255.1.1.007", "ip:10:25", "60"),
        ("+49 (0) 30 1234567 4111-1111-1111-1111", "", ""),
        ("4111-1111-1111-1111", "card:0:19", "80"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_single(spark, text, spans, scores):
    r = P.digests(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert (r["spans"], r["scores"]) == (spans, scores)


def test_very_long_texts(spark):
    """Long runs take neither a stack nor the square of their length; many matches get their places."""
    runs = ["a" * 300_000, "a." * 150_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + " " * 300_000, "A" * 300_000, "AB12" + "C " * 150_000, "a@" + "b." * 150_000, "a@b.c " * 20_000, "é 1.2.3.4 " * 20_000]
    got = {r["doc_id"]: r for r in P.digests(spark.createDataFrame(list(enumerate(runs)), SCHEMA).repartition(4)).collect()}
    for i, text in enumerate(runs):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in _fast(text)).encode()).hexdigest(), text[:9]
    assert got[9]["n_email"] == got[10]["n_ip"] == 20_000


def _fast(text: str) -> list[tuple]:
    """base_of() without the kinds whose mark isn't there, for which the stated expressions would take the square of a run."""
    marks = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    return base_of(text, {k for k, m in marks.items() if m in text})


def test_edges(spark):
    rows = [(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (2, None)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{SCHEMA}, spans string, row int, email string")
    got = sorted((r["doc_id"] or 0, r["spans"], r["n_added"]) for r in P.digests(docs).collect())
    assert got == [(0, "email:0:5", 0), (1, "email:0:5", 0), (1, "email:0:5", 0), (2, "", 0)]
    assert P.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = P.personal_data(docs.drop("spans")).collect()
    assert {(r["row"], r["email"]) for r in kept} == {(1, "y")} and [s["text"] for s in kept[0]["spans"]] == ["a@b.c"]


def test_native(spark):
    plan = P.digests(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
