"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their scores.

Column functions only; texts stay where they are, without a shuffle. A proposal's place comes
from the pieces between an expression's matches, whose lengths add up. The expressions give
the same leftmost matches as the plain ones they are named by, but begin only where a run
begins and never step back, so very long runs take time in proportion and no stack.

Kinds, in the order in which spans that start together stand:

    email, ip, card, phone    base: format, parts up to 255, 14 to 19 digits with Luhn's checksum, 10 to 15 digits
    iban                      a country's length and remainder 1 modulo 97
    ssn                       nnn-nn-nnnn in the ranges that are given out
    national                  7 to 12 digits in groups, a phone number without country

Each span scores by its kind; one of the kind's words in the 40 characters before it (as far
as the proposal before) or the 20 behind adds NEAR; a version's words take from an ip. Spans
that are added to the base stay from LEAST on, so ssn and national need a word nearby.
Base spans stay whatever they score. iban may overlap a base span; ssn and national are card proposals without
checksum, away from phone, ip and email characters, so they never do.

Defined cases: null text is empty and has no spans; repeated rows and rows without doc_id
give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base expressions as they are stated, and as Java runs them in linear time.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z][A-Z][0-9][0-9](\x20?[A-Z0-9])+"
FAST = {
    # A match may also begin amid a run, right behind the match before: \G.
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: PHONE,
    IBAN: r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])++",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national")
BASE = KINDS[:4]
#: Scores of a span without a word nearby, and what a word adds or takes, in hundredths.
SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 85, "ssn": 35, "national": 30}
NEAR, AGAINST, LEAST = 35, 40, 60
# Words that stand near a kind, in English, German, French and Spanish.
WORDS = {
    "email": "mail|email|e-mail|contact|kontakt|courriel|correo",
    "ip": "ip|address|host|server|adresse|serveur|servidor",
    "card": "card|visa|mastercard|credit|karte|kreditkarte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|telefon|handy|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|social security number|social security no",
    "national": "tel|phone|call|fax|mobile|telefon|handy|téléphone|teléfono",
}
SSN, NO_SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z", r"^(000|666|9)|-00-|-0000\z"
#: Of the form of an ssn or a date.
NO_PHONE = r"^([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4})\z"
VERSION = "version|release|build|v|ver"
# Lengths of IBANs by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 "
    "SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()
#: The longest IBAN and a space after each character.
IBAN_CHARS = 68
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths that are added up one after another; a text with more matches adds up such parts.
PART = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers that isn't empty."""
    none = F.array().cast("array<bigint>")

    def sums(values: Column, start: Column) -> Column:
        begin = F.struct(none.alias("out"), start.cast("long").alias("at"))
        return F.aggregate(values, begin, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"), (acc["at"] + x).alias("at")))["out"]

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0).cast("long")), sums(whole, F.lit(0)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(b, i)))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int")), lambda i: F.slice(lengths, i * PART + 1, F.lit(PART)))
    return let(parts, joined)


PROPOSAL = "array<struct<text:string,start:bigint,end:bigint,before:string,after:string>>"


def proposals(text: Column, pattern: str, gate: Column) -> Column:
    """Matches of ``pattern`` where ``gate`` holds: text, start, end, and the characters before and after, as far as the next matches."""
    fast = FAST[pattern]

    def placed(found: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            ends = running(F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long")))
            return let(ends, lambda e: F.transform(found, lambda m, i: F.struct(m.alias("text"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), F.right(F.get(pieces, i), F.lit(40)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(20)).alias("after"))))

        return F.when(F.size(found) > 0, let(F.split(text, fast, -1), with_pieces))

    return F.coalesce(F.when(gate, let(F.regexp_extract_all(text, F.lit(fast), F.lit(0)), placed)), F.array().cast(PROPOSAL))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has Luhn's checksum."""

    def share(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), share), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(compact: Column) -> Column:
    """The remainder of an IBAN without spaces, its first four characters last and letters as numbers from 10."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789" + UPPER), c) - 1
    return F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), lambda a, v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)


def says(span: Column, words: str) -> Column:
    """Whether one of ``words`` stands before or after a proposal."""
    pattern = f"(^|[^a-zà-ÿ])({words})([^a-zà-ÿ]|\\z)"
    low = lambda c: F.translate(c, UPPER, LOWER)
    return low(span["before"]).rlike(pattern) | low(span["after"]).rlike(pattern)


def iban_of(span: Column) -> Column:
    """struct(end, ok) of an iban proposal: where the country's length ends, and whether that is one."""
    lengths = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS for x in (c[:2], int(c[2:]))])
    head = F.left(span["text"], F.lit(IBAN_CHARS))
    size = F.coalesce(F.try_element_at(lengths, F.left(head, F.lit(2))), F.lit(0))
    places = F.filter(F.sequence(F.lit(1), F.lit(IBAN_CHARS)), lambda k: F.length(F.replace(F.left(head, k), F.lit(" "), F.lit(""))) == size)

    def whole(k: Column) -> Column:
        clear = ~span["before"].rlike(r"[A-Za-z0-9]\z") & ~F.concat(F.substr(span["text"], k + 1), span["after"]).rlike("^[A-Za-z0-9]")
        ok = (k > 0) & (k <= F.length(span["text"])) & clear & (mod97(F.replace(F.left(head, k), F.lit(" "), F.lit(""))) == 1)
        return F.struct((span["start"] + k).alias("end"), ok.alias("ok"))

    return let(F.coalesce(F.get(places, F.lit(0)), F.lit(0)), whole)


def apart(span: Column) -> Column:
    """Whether a card proposal touches nothing that an email, an ip or a phone number may hold."""
    before, after = span["before"], span["after"]
    # What stands between two proposals of one phone number is punctuation alone.
    inside = before.rlike(r"[A-Za-z0-9._%+@-]\z") | before.rlike(r"\+[\x20().-]*\z") | (before.rlike(r"^[\x20().-]+\z") & (F.length(before) < span["start"]))
    return ~inside & ~after.rlike(r"^[A-Za-z0-9_%+@-]") & ~after.rlike(r"^\.[A-Za-z0-9._%+@-]")


def _checks(kind: str, span: Column) -> Column:
    text, number = span["text"], digits(span["text"])
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) <= 3) & (F.coalesce(F.left(n, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(number).between(10, 15)
    if kind == "ssn":
        return text.rlike(SSN) & ~text.rlike(NO_SSN) & apart(span)
    return text.rlike("[\\x20-]") & ~text.rlike(NO_PHONE) & F.length(number).between(7, 12) & apart(span)


def _spans(kind: str, proposed: Column) -> Column:
    """Array of (start, kind_no, end, kind, text, score) of the proposals that pass the kind's checks."""

    def row(span: Column) -> Column:
        against = F.when(says(span, VERSION), AGAINST).otherwise(0) if kind == "ip" else F.lit(0)
        score = F.lit(SCORE[kind]) + F.when(says(span, WORDS[kind]), NEAR).otherwise(0) - against
        score = F.least(F.greatest(score, F.lit(0)), F.lit(100))
        end = iban_of(span)["end"] if kind == "iban" else span["end"]
        shown = F.left(span["text"], (end - span["start"]).cast("int")) if kind == "iban" else span["text"]
        return F.struct(span["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), shown.alias("text"), score.alias("score"))

    good = F.filter(proposed, lambda s: iban_of(s)["ok"] if kind == "iban" else _checks(kind, s))
    rows = F.transform(good, row)
    return rows if kind in BASE else F.filter(rows, lambda s: s["score"] >= LEAST)


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with spans (in place of a column of that name): array of (start, kind_no, end, kind, text, score) by start, then kind; code points, end exclusive."""
    held = docs.drop("spans").select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, some = F.col("text"), F.col("text").rlike("[0-9]")
    proposed = held.select(
        "row",
        proposals(text, EMAIL, text.contains("@")).alias("email"),
        proposals(text, IP, some).alias("ip"),
        proposals(text, CARD, some).alias("card"),
        proposals(text, PHONE, text.contains("+")).alias("phone"),
        proposals(text, IBAN, text.rlike("[A-Z][A-Z][0-9][0-9]")).alias("iban"),
    )
    of = {"ssn": "card", "national": "card"}
    found = F.array_sort(F.concat(*[_spans(k, F.col(of.get(k, k))) for k in KINDS]))
    return proposed.select("row.*", found.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_added) for each row of ``docs``."""
    found = personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.col("spans").alias("s"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("s", lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("s", name), ",").alias("spans"),
        F.array_join(F.transform("s", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.size(F.filter("s", lambda s: s["kind_no"] >= len(BASE))).cast("long").alias("n_added"),
    )
