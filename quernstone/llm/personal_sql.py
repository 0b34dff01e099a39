"""op12_personal_data as SQL for an independent engine: every proposal is a row."""

from quernstone.llm import personal as P

_BASE = {"email": P.EMAIL, "ip": P.IP, "card": P.CARD, "phone": P.PHONE, "iban": P.IBAN}
_FROM = {"ssn": "card", "national": "card"}


def _proposals(kind: str, pattern: str) -> str:
    return f"""
{kind}_m as materialized (select nth, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from d),
{kind}_p as materialized (select nth, m[i] as m, p[i][-40:] as before, p[i + 1][:20] as after,
  cast(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: i - 1], lambda x: length(x))), 0) as bigint) as s
  from (select nth, m, p, unnest(range(1, len(m) + 1)) as i from {kind}_m))"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: case when i % 2 = 1 then cast(c as int) else cast(c as int) * 2 - case when cast(c as int) > 4 then 9 else 0 end end)) % 10 = 0"
_APART = r"""not regexp_matches(before, '[A-Za-z0-9._%+@-]\z') and not regexp_matches(before, '\+[\x20().-]*\z') and not (regexp_matches(before, '^[\x20().-]+\z') and length(before) < s)
  and not regexp_matches(after, '^[A-Za-z0-9_%+@-]') and not regexp_matches(after, '^\.[A-Za-z0-9._%+@-]')"""
_IBAN = f"""(
  select nth, m[:k] as m, before, after, s, k from (select *, list_filter(range(1, {P.IBAN_CHARS + 1}), lambda j: length(replace(m[:{P.IBAN_CHARS}][:j], ' ', '')) = size)[1] as k
    from (select *, map {{{', '.join(f"'{c[:2]}': {int(c[2:])}" for c in P.IBAN_LENGTHS)}}}[m[:2]] as size from iban_p))
  where k <= length(m) and not regexp_matches(before, '[A-Za-z0-9]\\z') and not regexp_matches(m[k + 1:] || after, '^[A-Za-z0-9]')
  and list_reduce(list_transform(string_split(replace(m[:k], ' ', '')[5:] || m[:4], ''), lambda c: instr('0123456789{P.UPPER}', c) - 1), lambda a, v: (a * case when v < 10 then 10 else 100 end + v) % 97, 0) = 1)"""
_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || left(ltrim(x, '0'), 3) as int) > 255)) = 0",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
    "iban": "true",
    "ssn": f"regexp_matches(m, '{P.SSN}') and not regexp_matches(m, '{P.NO_SSN}') and {_APART}",
    "national": f"regexp_matches(m, '[\\x20-]') and not regexp_matches(m, '{P.NO_PHONE}') and length({_DIGITS}) between 7 and 12 and {_APART}",
}


def _says(words: str) -> str:
    low = lambda c: f"regexp_matches(translate({c}, '{P.UPPER}', '{P.LOWER}'), '(^|[^a-zà-ÿ])({words})([^a-zà-ÿ]|\\z)')"
    return f"({low('before')} or {low('after')})"


def _spans(kind: str) -> str:
    against = f"case when {_says(P.VERSION)} then {P.AGAINST} else 0 end" if kind == "ip" else "0"
    score = f"least(greatest({P.SCORE[kind]} + case when {_says(P.WORDS[kind])} then {P.NEAR} else 0 end - {against}, 0), 100)"
    table = _IBAN if kind == "iban" else f"{_FROM.get(kind, kind)}_p"
    kept = "true" if kind in P.BASE else f"score >= {P.LEAST}"
    return f"select * from (select nth, s, s + length(m) as e, '{kind}' as kind, {P.KINDS.index(kind)} as kind_no, {score} as score from {table} where {_CHECKS[kind]}) where {kept}"


OP12_SQL = f"""
with d as materialized (select row_number() over () as nth, doc_id, coalesce(text, '') as t from documents), {', '.join(_proposals(k, v) for k, v in _BASE.items())},
spans as ({' union all '.join(_spans(k) for k in P.KINDS)}),
found as (select nth, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in P.BASE)}, count(*) filter (kind_no >= {len(P.BASE)}) as n_added,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no, e) filter (kind_no < {len(P.BASE)}) as base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no, e) as spans, string_agg(cast(score as varchar), ',' order by s, kind_no, e) as scores from spans group by nth)
select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in P.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores, coalesce(n_added, 0) as n_added
from d left join found using (nth)
"""
