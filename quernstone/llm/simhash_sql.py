"""SQL for the near-duplicate query: XXH64 in wide integers, fingerprints bit by bit, every pair compared."""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WIDE = "18446744073709551616::uhugeint"


def _n(x: int) -> str:
    return f"{x % (1 << 64)}::uhugeint"


def _times(x: str, prime: int) -> str:
    return f"(({x}) * {_n(prime)} % {WIDE})"


def _plus(x: str, y: str) -> str:
    return f"((({x}) + ({y})) % {WIDE})"


def _turned(x: str, bits: int) -> str:
    """``x``, an expression, rotated to the left; bound to a name so that it stands once."""
    return f"list_reduce([0::uhugeint, {x}], lambda o, t: t * {_n(1 << bits)} % {WIDE} + t // {_n(1 << (64 - bits))})"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_plus(acc, _times(lane, P2)), 31), P1)


def _lane(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes at byte ``at`` of the hexadecimal text x."""
    return f"cast('0x' || {' || '.join(f'substring(x, 2 * ({at}) + {2 * k + 1}, 2)' for k in reversed(range(size)))} as ubigint)::uhugeint"


def _fold(start: str, lanes: str, step: str) -> str:
    """``start`` taken through ``step`` (of h and t) for each of ``lanes``."""
    return f"list_reduce(list_prepend({start}, {lanes}), lambda h, t: {step})"


def xxh64(strings: str, seed: int = 42) -> str:
    """A query with (s, h) of each distinct s of the query ``strings``."""
    four = [seed + P1 + P2, seed + P2, seed, seed - P1]
    lanes = [f"list_transform(range(0, n // 32), lambda k: {_lane(f'32 * k + {8 * j}', 8)})" for j in range(4)]
    v = ", ".join(f"{_fold(_n(start), lane, _round('h', 't'))} as v{j}" for j, (start, lane) in enumerate(zip(four, lanes)))
    mixed = _plus(_plus(_turned("v0", 1), _turned("v1", 7)), _plus(_turned("v2", 12), _turned("v3", 18)))
    merged = _fold(mixed, "[v0, v1, v2, v3]", _plus(_times(f"xor(h, {_round('0::uhugeint', 't')})", P1), _n(P4)))
    eights = f"list_transform(range(n // 32 * 4, n // 8), lambda k: {_lane('8 * k', 8)})"
    whole = _fold(_plus("h0", "n::uhugeint"), eights, _plus(_times(_turned(f"xor(h, {_round('0::uhugeint', 't')})", 27), P1), _n(P4)))
    fours = f"list_transform(range(n // 8 * 2, n // 4), lambda k: {_lane('4 * k', 4)})"
    halves = _fold("h1", fours, _plus(_times(_turned(f"xor(h, {_times('t', P1)})", 23), P2), _n(P3)))
    ones = f"list_transform(range(n // 4 * 4, n), lambda k: {_lane('k', 1)})"
    bytes_ = _fold("h2", ones, _times(_turned(f"xor(h, {_times('t', P5)})", 11), P1))
    out = f"select s, hex(encode(s)) as x, strlen(s) as n from (select distinct s from ({strings}))"
    out = f"select *, {v} from ({out})"
    out = f"select s, x, n, case when n < 32 then {_n(seed + P5)} else {merged} end as h0 from ({out})"
    for name, now in (("h1", whole), ("h2", halves), ("h3", bytes_)):
        out = f"select s, x, n, {now} as {name} from ({out})"
    for k, (bits, prime) in enumerate(((33, P2), (29, P3), (32, 1))):
        out = f"select s, {_times(f'xor(h{k + 3}, h{k + 3} // {_n(1 << bits)})', prime)} as h{k + 4} from ({out})"
    return f"select s, h6::ubigint as h from ({out})"


_BITS = ", ".join(f"sum((h >> {b}) & 1) as b{b}" for b in range(64))
_PRINT = " + ".join(f"case when 2 * b{b} > n then {1 << b}::ubigint else 0::ubigint end" for b in range(64))
OP10_SQL = rf"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingles as materialized (select doc_id, array_to_string(w[k : k + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as k from w where len(w) > 0)),
hashed as materialized ({xxh64("select s from shingles")}),
bits as (select doc_id, count(*) as n, {_BITS} from shingles join hashed using (s) group by doc_id),
prints as materialized (select w.doc_id, coalesce({_PRINT}, 0::ubigint) as fp from w left join bits using (doc_id)),
nodes as materialized (select fp, min(doc_id) as least from prints group by fp),
links as materialized (select a.fp as a, b.fp as b from nodes a, nodes b where a.fp <> b.fp and bit_count(xor(a.fp, b.fp)) <= 2),
reached as (select a, b from links union select r.a, links.b from reached r join links on r.b = links.a),
parts as (select a as fp, min(least) as least from reached join nodes on nodes.fp = b group by a)
select p.doc_id, lower(lpad(to_hex(p.fp), 16, '0')) as fingerprint, least(nodes.least, coalesce(parts.least, nodes.least)) as component_id
from prints p join nodes on nodes.fp = p.fp left join parts on parts.fp = p.fp
"""
