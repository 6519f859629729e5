"""DuckDB SQL of equal rows for the operators of which it can be said: near-duplicates by all pairs of shared shingles, and secrets with their links."""

from __future__ import annotations

from . import conversation_repair as R
from . import secret_links as S

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * i >= 75 * (na + nb - i)),
u as (select a, b from l union all select b, a from l),
r(node, seen) as (select a, b from u union select r.node, u.b from r join u on u.a = r.seen),
c as (select node, min(seen) as low from r group by node)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) as component_id, s.doc_id <= coalesce(low, s.doc_id) as kept from s left join c on node = s.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets() -> str:
    """Lengths of gaps and matches give the positions, as in the operator; every part of a document is held against every other."""
    run = r"[A-Za-z0-9+/=_-]+"
    plain = {"hex": r"[0-9a-f]{32,}", "bare": run}  # SQL has no looking behind: whole runs, of which the fitting ones are taken
    fits = {
        "assign": lambda k: f"length(regexp_extract(h, {_quoted(k.pattern)}, 2)) >= {k.least}",
        "ident": lambda k: f"length(regexp_extract(h, {_quoted(k.pattern)}, 1)) >= {k.least}",
        "bare": lambda k: "length(h) = 40 and not regexp_matches(h, '[=_-]') and regexp_matches(h, '[a-z]') and regexp_matches(h, '[A-Z]') and regexp_matches(h, '[0-9]')",
    }
    parts = []
    for n, k in enumerate(S.KINDS):
        pattern = _quoted(plain.get(k.name, k.pattern))
        fit = fits.get(k.name, lambda k: f"length(h) >= {k.least}")(k)
        parts.append(
            f"select doc_id, {n} as kind, '{k.role}' as role, a, a + length(h) as b from (select doc_id, h, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0) as a from"
            f" (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i, unnest(hits) as h from (select doc_id, regexp_extract_all(t, {pattern}) as hits, string_split_regex(t, {pattern}) as gaps from d))) where {fit}"
        )
    weak = ", ".join(str(n) for n, k in enumerate(S.KINDS) if k.weak)
    names = "[" + ", ".join(f"'{k.name}'" for k in S.KINDS) + "]"
    counts = ", ".join(f"count(*) filter (kind = {n}) as n_{k.name}" for n, k in enumerate(S.KINDS) if not k.weak)
    text = f"string_agg({names}[kind + 1] || ':' || cast(a as bigint) || ':' || cast(b as bigint), ',' order by a, kind)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents), p as ({" union all ".join(parts)}),
    met as (select w.doc_id, w.kind, w.role, w.a, w.b, bool_or(o.role = 'identifier') as named, bool_or(o.role = 'secret') as secret from p w join p o on o.doc_id = w.doc_id and o.role <> w.role and o.a < w.b + {S.REACH} and o.b > w.a - {S.REACH}
      where w.kind in ({weak}) group by all),
    kept as (select doc_id, kind, a, b from p where kind not in ({weak}) union all select doc_id, kind, a, b from met where case role when 'identifier' then secret when 'secret' then named else named and secret end),
    g as (select doc_id, {counts}, count(*) filter (kind in ({weak})) as n_linked, {text} as spans, {text.replace("order by a, kind)", "order by a, kind) filter (kind not in (" + weak + "))")} as base from kept group by doc_id)
    select doc_id, {", ".join(f"coalesce(n_{k.name}, 0) as n_{k.name}" for k in S.KINDS if not k.weak)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked from d left join g using (doc_id)
    """


TOP_K = """
with v as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as p from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (select q.n, q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.p, c.p, true), lambda z: z[1] * z[2])), 0) as bigint) as score from v q join v c on q.n <> c.n where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def _repair() -> str:
    """The damage with crc32 spelt out, the faults by windows, and one recursion over the rows of all conversations that keeps the repaired lines as well."""
    steps = []
    for state, row, after, cost, letters in R.moves():
        inserted, at = [], state
        for _ in letters[:-1]:
            role = "a" if at == 2 else "u"
            inserted.append(R.ROLES[role] + ":")
            at = R.NEXT[at, role]
        steps.append(f"({state}, '{row}', {after}, {cost}, '{letters}', {inserted}::varchar[], '{'assistant' if at == 2 else 'user'}')")
    ends = []
    for state, cost, letters in R.closing():
        ends.append(f"({state}, {cost}, '{letters}', {['assistant:'] if letters == 'I' else ['user:', 'assistant:'] if letters else []}::varchar[])")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    with recursive k as (select *, cast(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as varchar) as key from conversations),
    h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as kind from k),
    d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case kind when 3 then [0, 1] else [0] end) as copy from h where kind <> 0),
    f as (select *, rtrim(text, {space}) as t, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as r, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen from d),
    g as (select *, t = '' as blank, t <> '' and seen as duplicate, t <> '' and not seen and right(t, 1) not in ('.', '!', '?') as truncated, left(role, 1) as own, lag(left(role, 1)) over (partition by conv_id order by r) as before from f),
    c as (select *, case when blank or duplicate then 'd' when own not in ('s', 'u', 'a') then case when truncated then 'O' else 'o' end when truncated then upper(own) else own end as code from g),
    a as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
      count(*) filter (before is not null and before || own not in ('su', 'ua', 'au')) as illegal from c group by conv_id),
    m(state, row, next, cost, letters, inserted, other) as (values {", ".join(steps)}),
    e(state, cost, letters, inserted) as (values {", ".join(ends)}),
    w as (select conv_id, 0::bigint as i, 0 as state, 0 as cost, '' as audit, []::varchar[] as lines from a
      union all select conv_id, i + 1, next, b.cost, b.audit, b.lines from (select w.conv_id, w.i, m.next, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.letters, 'lines': list_concat(w.lines, m.inserted,
        case right(m.letters, 1) when 'K' then [c.role || ':' || c.text] when 'R' then [m.other || ':' || c.text] else [] end)}}) as b
        from w join c on c.conv_id is not distinct from w.conv_id and c.r = w.i + 1 join m on m.state = w.state and m.row = c.code group by w.conv_id, w.i, m.next)),
    z as (select a.conv_id, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.letters, 'lines': list_concat(w.lines, e.inserted)}}) as b from a join w on w.conv_id is not distinct from a.conv_id and w.i = a.n join e on e.state = w.state group by a.conv_id)
    select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
      cast(coalesce(b.cost, 0) as bigint) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) o left join a on a.conv_id is not distinct from o.conv_id left join z on z.conv_id is not distinct from o.conv_id
    """


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_dedup": NEAR_DUPLICATES, "op7_secret_links": _secrets(), "op11_bitsliced_topk": TOP_K, "op12_conversation_repair": _repair()}
