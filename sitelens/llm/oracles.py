"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

_OP9 = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""

_OP8 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, row_number() over w as n, count(*) over (partition by conv_id) as last,
    sum(8 + 8 + 7 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))
      over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto
  from c window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or n = last)::bigint as formatted_chars
from e group by conv_id
"""

_OP10 = """
with recursive d as (select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
r as (select *, 1.5::double * sum(source_size) over () - 2::double * coalesce(sum(source_size) over b, 0) as remaining,
    sum(weight) over () - coalesce(sum(weight) over b, 0) as weights
  from s window b as (order by source_size::double / weight, source nulls first rows between unbounded preceding and 1 preceding)),
q as (select *, weight * remaining / weights >= 2::double * source_size as capped from r),
l as (select *, min(case when not capped then source_size::double / weight end) over () as cut from q),
v as (select *, max(case when not capped and source_size::double / weight = cut then remaining end) over () as lr,
    max(case when not capped and source_size::double / weight = cut then weights end) over () as lw from l),
t as (select source, source_size, case when capped then 2::double * source_size else weight * lr / lw end as target from v),
m as (select floor(sum(target) / 32 + 0.5)::bigint as blocks from t),
k as (select source, i, row_number() over (order by target / (2 * i - 1) desc, source nulls last, i) as rank
  from t, range(1, (select blocks from m) + 1) as g(i) where target > 0 and i <= target / 32 + (select count(*) from t) + 2),
w as (select source, 32 * count(*) as words from k where rank <= (select blocks from m) group by source),
p as (select t.*, least(coalesce(words, 0), 2 * source_size)::bigint as q from t left join w on t.source is not distinct from w.source),
o as (select *, sum(size) over (partition by source order by md5('42:' || doc_id), size rows unbounded preceding) - size as start from d)
select doc_id, size, source_size, target,
  (case when source_size > 0 then q // source_size * size + greatest(0, least(size, q % source_size - start)) else 0 end)::bigint as taken,
  o.source, start::bigint as start,
  case when size > 0 and start < q then start // 32 end::bigint as block,
  case when size > 0 and start < q then (select count(*) from range(1, 9) as h(h) where (select blocks from m) * h // 8 < k.rank) end::int as shard
from o join p on o.source is not distinct from p.source left join k on k.source is not distinct from o.source and k.i = start // 32 + 1
"""

_SIGNALS = """
  d as (select doc_id, lang as stratum, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
  win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
  keyed as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from win),
  rep as (select doc_id, count(distinct i + x) as n_repeat_words from keyed, range(3) as r(x) where c > 1 group by doc_id),
  s as (select doc_id, stratum, len(w)::bigint as n_words, length(list_aggregate(w, 'string_agg', ''))::bigint as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, length(regexp_replace(text, '[^!?]+', '', 'g'))::bigint as n_marks
    from d left join rep using (doc_id)),
  b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
"""

_OP5 = "with" + _SIGNALS + """
  cuts as (select unnest(range(1, 9)) as level, unnest([0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02])::double as symbols,
      unnest([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3])::double as dup_lines, unnest([0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15])::double as repeats,
      unnest([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2])::double as marks),
  hit as (select doc_id, stratum, level, n_symbols::double / word_chars >= symbols or n_dup_lines::double / n_lines >= dup_lines
      or n_repeat_words::double / n_words >= repeats or n_marks::double / n_words >= marks as bad from b, cuts where not base_failed),
  good as (select distinct doc_id from labels where quality = 1),
  counts as (select stratum, level, count(*)::bigint as n, count(*) filter (bad)::bigint as k from hit semi join good using (doc_id) group by all),
  tested as (select *, k < n * 0.02 and list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98))))
      <= 0.05 * n / (select sum(n) from counts where level = 1) as passed from counts),
  used as (select stratum, coalesce(min(level) filter (not passed), 9) - 1 as level from tested group by stratum),
  gone as (select doc_id from hit join used on hit.level = used.level and hit.stratum is not distinct from used.stratum where bad)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from gone) as kept from b
"""

def _op11(rounds: int = 6) -> str:
    """Lloyd rounds in integers, unrolled; every distance is computed."""
    square = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    sql = """with k as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label,
      list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as materialized (select r, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] as x from k, range(8) as t(part)),
    b0 as materialized (select part, r - 1 as e, x from p where r <= 16)"""
    for i in range(1, rounds + 2):
        sql += f""", a{i} as materialized (select r, part, any_value(x) as x, min(struct_pack(d := d, e := e)) as best from (
          select p.r, p.part, p.x, b.e, {square.format("p.x", "b.x")} as d from p join b{i - 1} b on p.part = b.part) group by r, part)"""
        if i <= rounds:
            sql += f""", b{i} as materialized (select part, e, coalesce(n.x, b.x) as x from b{i - 1} b left join (
          select part, e, list(case when s >= 0 then s // c else -((c - 1 - s) // c) end order by place) as x from (
            select part, best.e as e, place, sum(x[place])::bigint as s, count(*)::bigint as c
            from (select *, unnest(range(1, len(x) + 1)) as place from a{i}) group by all) group by part, e) n using (part, e))"""
    last = rounds + 1
    return sql + f""", c as (select r, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a{last} group by r)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
      (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) from b{rounds}) as codebooks_sha256 from c join k using (r)"""


def _merkle_levels(at: str, levels: int) -> str:
    """Levels over {at}0 (g, pos, h): runs of two until a group has one node; {at}w (g, i, pos, path), path from below."""
    sql = f"{at}w0 as materialized (select g, pos as i, pos, []::struct(h varchar, l boolean)[] as path from {at}0)"
    for k in range(levels):
        n = f"select *, count(*) over (partition by g) as many from {at}{k}"
        sql += f""", {at}{k + 1} as materialized (select g, pos // 2 as pos, case when max(many) = 1 then max(h) else sha256(string_agg(h, '' order by pos)) end as h
          from ({n}) group by g, pos // 2),
        {at}w{k + 1} as materialized (select w.g, w.i, w.pos // 2 as pos, case when (select count(*) from {at}{k} c where c.g = w.g) = 1 then path
          else list_append(path, struct_pack(h := coalesce(s.h, ''), l := coalesce(s.pos < w.pos, false))) end as path
          from {at}w{k} w left join {at}{k} s on s.g = w.g and s.pos = case when w.pos % 2 = 0 then w.pos + 1 else w.pos - 1 end)"""
    return sql + f", {at}w as (select g, i, path from {at}w{levels}), {at}top as (select g, h from {at}{levels})"


def _op13(levels: int = 18, langs: int = 8) -> str:
    """All levels unrolled (2^18 rows a language, 2^8 languages)."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda chars: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"
    # CRC-32: a byte enters, then eight steps (a -1 each) divide by the reversed polynomial
    crc = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295)"""
    return f"""with d as materialized (select doc_id, case when lang is null then '0' else '1' || lang end as g, {leaf("n_chars")} as h,
        case when {crc} % 7 = 0 then {leaf("(n_chars + 1)")} else {leaf("n_chars")} end as t from documents),
      r as materialized (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos from d),
      n0 as materialized (select g, pos, h from r), {_merkle_levels("n", levels)},
      m0 as materialized (select '' as g, row_number() over (order by encode(g)) - 1 as pos, h from ntop),
      names as (select g, row_number() over (order by encode(g)) - 1 as i from ntop), {_merkle_levels("m", langs)},
      f as (select r.doc_id, r.h as leaf, r.t, ntop.h as subroot, mtop.h as root, list_concat(nw.path, mw.path) as path
        from r join nw on nw.g = r.g and nw.i = r.pos join ntop on ntop.g = r.g join names on names.g = r.g join mw on mw.i = names.i cross join mtop),
      e as (select *, list_reduce(list_concat([struct_pack(h := t, l := false)], path), lambda a, s:
        struct_pack(h := sha256(case when s.l then s.h || a.h else a.h || s.h end), l := false)).h as folded_root from f)
      select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.h), '')) as proof_sha256, folded_root, folded_root = root as verified from e"""


ORACLES: dict[str, str] = {
    "op5_quality_rules": _OP5,
    "op8_chat_format": _OP8,
    "op9_exact_dedup": _OP9,
    "op10_mix_sources": _OP10,
    "op11_vector_codes": _op11(),
    "op13_merkle_manifest": _op13(),
}
