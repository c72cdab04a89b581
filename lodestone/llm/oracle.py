"""SQL counterparts of the pN_ queries, where SQL can express them on whole tables."""

from __future__ import annotations

#: One spelling a source and the distinct usable rows, as common table expressions.
_ROWS = r"""
named as (select row_id, length(text) as n_chars, loaded_at,
    replace(lower(regexp_replace(source, '^[ \t\r\n\x{A0}\x{3000}]+|[ \t\r\n\x{A0}\x{3000}]+$', '', 'g')), '-', '_') as s
  from seed_corpus where regexp_matches(text, '[^ \t\r\n\x{A0}\x{3000}]')),
rows_ as (select row_id, min_by(case when s is null or s = '' then 'unknown' else s end, loaded_at) as name, min_by(n_chars, loaded_at) as n_chars
  from named group by row_id),
sizes as (select name, sum(n_chars) as size from rows_ group by name),
joined as (select m.plan_id, m.source, m.source as name, m.weight, m.max_repeats, m.budget_ratio, coalesce(z.size, 0) as size
  from mix_plan m left join sizes z on z.name = m.source),
targets as (select *, weight / sum(weight) over (partition by plan_id) as share,
    weight / sum(weight) over (partition by plan_id) * (budget_ratio * sum(size) over (partition by plan_id)) as target from joined)"""



def _named(c: str) -> str:
    """A name of the earliest delivery under one spelling."""
    name = rf"lower(regexp_replace({c}, '^[ \t\r\n\x{{A0}}\x{{3000}}]+|[ \t\r\n\x{{A0}}\x{{3000}}]+$', '', 'g'))"
    name = {"source": f"replace({name}, '-', '_')", "lang": f"split_part(replace({name}, '_', '-'), '-', 1)"}.get(c, name)
    return f"min_by(case when {name} is null or {name} in ('', {"'und'" if c == 'lang' else "''"}) then 'unknown' else {name} end, loaded_at)"


SQL: dict[str, str] = {
    "p1_found": r"""select distinct row_id from seed_corpus
        where length(regexp_replace(text, '^[ \t\r\n\x{A0}\x{3000}]+|[ \t\r\n\x{A0}\x{3000}]+$', '', 'g')) > 3500""",
    "p1_restored": """select row_id, sha256(t) as text_hash, true as within_limit, true as within_overlap, true as numbered, true as cut
        from (select row_id, min_by(text, loaded_at) as t from seed_corpus where length(text) > 3500 group by row_id)""",
    "p2_usable_text": f"""with once as (select row_id, {_named('source')} as source, {_named('lang')} as lang, {_named('domain')} as domain, min_by(length(text), loaded_at) as n_chars
          from seed_corpus where regexp_matches(text, '[^ \\t\\r\\n\\x{{A0}}\\x{{3000}}]') group by row_id)
        select case grouping_id(source, lang, domain) when 0 then 'cell' when 3 then 'source' when 5 then 'lang' when 6 then 'domain' else 'all' end as slice, source, lang, domain,
          count(*) as n_rows, cast(sum(n_chars) as bigint) as n_chars from once group by grouping sets ((source, lang, domain), (source), (lang), (domain), ())""",
    "p4_found": f"with {_ROWS} select plan_id, source from targets where size * max_repeats < target",
    "p4_shares": f"""with {_ROWS},
        streams as (select *, sum(n_chars) over (partition by name order by sha256('42:mix:' || row_id || ':'), row_id rows unbounded preceding) - n_chars as before from rows_),
        used as (select plan_id, source, n_chars, cast(least(max_repeats, greatest(0, floor((target - before - n_chars / 2.0) / size) + 1)) as bigint) as copies
          from streams join targets using (name)),
        reached as (select plan_id, source, sum(n_chars * copies) as actual_chars, sum(copies) as n_rows, max(copies) as max_copies from used where copies > 0 group by all),
        whole as (select t.plan_id, t.source, t.share, t.target, coalesce(r.actual_chars, 0) as actual_chars, coalesce(r.n_rows, 0) as n_rows, coalesce(r.max_copies, 0) as max_copies, t.size * t.max_repeats < t.target as short
          from targets t left join reached r on r.plan_id = t.plan_id and r.source = t.source)
        select plan_id, source, round(share, 6) as target_share, round(target, 6) as target_chars, cast(actual_chars as bigint) as actual_chars,
          round(cast(actual_chars as double) / sum(actual_chars) over (partition by plan_id), 6) as actual_share, cast(n_rows as bigint) as n_rows, cast(max_copies as bigint) as max_copies, short from whole""",
}
