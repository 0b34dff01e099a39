"""Queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.personal_sql import OP12_SQL
from quernstone.llm.simhash_sql import OP10_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernstone.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, breaks="words")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), query_every=20, id_column="vec_id", vector_column="embedding", k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.quality import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.language_model import scores

    return scores(table(spark, sf_dir, "documents"), held_out_of=(7, 2))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.repeats import digests

    return digests(table(spark, sf_dir, "documents"), length=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernstone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.licences import licences

    return licences(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least=10, top=10)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.personal import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_neighbours, op4_quality, op5_language_model, op6_suffix_dedup, op7_packing, op8_decontamination, op9_licences, op10_simhash, op11_divergence, op12_personal_data)}
# Item windows against every place of every document, word for word.
OP8_SQL = r"""
with w as (
  select item_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null and text is not null
), win as (
  select distinct cast(item_id as varchar) as item_id, w[s : s + 9] as words, len(w[s : s + 9]) as size
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from w where len(w) > 0)
), d as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), cut as (
  select doc_id, s, size, w[s : s + size - 1] as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from d, (select distinct size from win) where len(w) >= size)
), hit as (select distinct doc_id, item_id, s, cut.size from cut join win on cut.words = win.words),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hit) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join found using (doc_id)
"""

# Every string of 100 bytes (200 hexadecimal digits) against every other.
OP6_SQL = """
with d as (select doc_id, row_number() over (order by doc_id) as nth, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
s as (select doc_id, nth * 4294967296 + i as place, i, substring(h, 2 * i + 1, 200) as string from (select *, unnest(range(0, n - 99)) as i from d where n >= 100)),
later as (select doc_id, i from (select *, min(place) over (partition by string) as first from s) where place > first),
edges as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from later),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from (select *, sum(fresh) over (partition by doc_id order by i) as run from edges) group by doc_id, run),
kept as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from runs
  union all select d.doc_id, coalesce(max(runs.b), 0), any_value(n) from d left join runs using (doc_id) group by d.doc_id
),
texts as (select doc_id, sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' order by a, b))) as kept_sha256 from kept join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256
from d join texts using (doc_id) left join (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id) using (doc_id)
"""

# A dense grid of groups and kept terms, in 128-bit integers.
OP11_SQL = r"""
with d as (
  select row_number() over () as nth, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), w as (select nth, lang, source, unnest(w) as term from d),
v as materialized (select lang, term from w group by lang, term having count(distinct nth) >= 10),
c as materialized (select lang, source, term, count(*) as n from w join v using (lang, term) group by lang, source, term),
g as materialized (select distinct lang, source from d),
kept as (select lang, count(*) as v from v group by lang),
grid as (select g.lang, g.source, v.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total, kept.v
  from g join v using (lang) join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
p as materialized (select lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 2)) // (cast(total as hugeint) + 2 * v) as p from grid),
whole as (select lang, term, sum(n) as n, sum(sum(n)) over (partition by lang) as total from p group by lang, term),
q as (select lang, term, 1 + (cast(1000000000 as hugeint) * (cast(n as hugeint) + 2)) // (cast(total as hugeint) + 2 * v) as q from whole join kept using (lang)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op6_suffix_dedup": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_simhash": OP10_SQL, "op11_divergence": OP11_SQL, "op12_personal_data": OP12_SQL}
