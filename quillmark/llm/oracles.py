"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillmark.llm import line_dedup, mixing, url_cascade

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
    rules = sorted(url_cascade.RULES, key=lambda r: (-len(r[1]), -len(r[2])))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"when {fits(h, p)} then '{kind}'" for kind, h, p in rules)
    listed = " or ".join(f"host = '{k}' or ends_with(host, '.{k}')" for k in url_cascade.LISTED_KEYS)
    return f"""with u as (select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') as host,
coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages)
select page_id, host, path, case {rule} end as rule, case {verdict} when {listed} then 'block' else 'allow' end as verdict from u"""


_LINES = f"""with l as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
t as (select source, count(*) as total from documents group by 1),
c as (select source, line, count(*) as pages from (select source, unnest(list_distinct(lines)) as line from l) where not regexp_full_match(line, '[\\x20\\x09-\\x0D]*') group by 1, 2),
d as (select source, list(line) as gone from c join t using (source) where pages >= {line_dedup.LEAST_PAGES} and pages / total > {line_dedup.RATIO} group by 1),
k as (select doc_id, text, lines, list_filter(lines, lambda x: not list_contains(coalesce(gone, []), x)) as kept from l left join d using (source))
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(len(lines) - len(kept), 0) as bigint) as n_dropped, case when len(kept) < len(lines) then array_to_string(kept, chr(10)) else text end as text from k"""


def _quotas(parties: str, group: str, votes: str, seats: str, tie: str) -> str:
    """A query that adds quota to ``parties`` by highest quotients."""
    part = f"partition by {group}" if group else ""
    by = f"partition by {group} order by" if group else "order by"
    return f"""(with a as (select *, sum({votes}) over ({part}) as av, count(*) over ({part}) as an from {parties}),
b as (select *, case when av > 0 then {votes} / av else 0 end as share from a),
r as (select *, cast(ceil(share * (an + 1) / 2) + 1 as bigint) as reach from b),
s as (select *, greatest(0, cast(floor(share * {seats}) as bigint) - reach) as base from r),
e as (select *, {seats} - sum(base) over ({part}) as rest from s),
x as (select *, unnest(range(base, base + 2 * reach + 2)) as seat from e),
q as (select *, {votes} / (2 * seat + 1) as quotient from x),
k as (select *, row_number() over ({by} quotient desc, {tie}) as place_ from q)
select {group + ', ' if group else ''}{tie}, cast(any_value(base) + count_if(place_ <= rest and quotient > 0) as bigint) as quota from k group by {group + ', ' if group else ''}{tie})"""


def _mix_sql() -> str:
    m = mixing
    weight = "case place % 3 " + " ".join(f"when {i} then {w}" for i, w in enumerate(m.WEIGHTS)) + " end"
    draw = lambda text: f"cast('0x' || substr(sha256({text}), 1, 15) as bigint)"
    return f"""with z as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
t0 as (select source, cast(sum(size) as bigint) as ss from z group by 1),
t1 as (select *, row_number() over (order by source nulls last) - 1 as place from t0),
t2 as (select *, {weight} as weight, cast(sum(ss) over () as bigint) as everything from t1),
t3 as (select *, cast(coalesce(sum({m.MOST} * ss) over (order by ss / weight, place rows between unbounded preceding and 1 preceding), 0) as bigint) as capped,
  cast(sum(weight) over (order by ss / weight, place rows between current row and unbounded following) as bigint) as weights_on from t2),
t4 as (select *, ({m.SHARE_PERCENT} * everything - capped * 100) / (weights_on * 100) as own_level from t3),
lv as (select arg_min(own_level, struct_pack(a := ss / weight, b := place)) as level from t4 where own_level * weight < {m.MOST} * ss),
t5 as (select source, ss, place, everything, case when own_level * weight < {m.MOST} * ss then least(level * weight, cast({m.MOST} * ss as double)) else cast({m.MOST} * ss as double) end as target from t4 left join lv on true),
t6 as (select *, greatest(1, least({m.BLOCK_WORDS}, everything // {m.LEAST_BLOCKS})) as block, greatest({m.SHARD_WORDS}, cast(ceil(everything / {m.MOST_SHARDS}) as bigint)) as shard_of from t5),
t7 as (select *, cast(ceil(greatest(ss, 1) / shard_of) as bigint) as shards, cast(round(sum(target) over () / block) as bigint) as blocks from t6),
tq as {_quotas('t7', '', 'target', 'blocks', 'place')},
dealt as (select z.doc_id, z.size, t7.place, t7.ss, t7.target, t7.block, quota as source_blocks, {draw(f"'{m.SEED}:' || z.doc_id")} as ord, {draw(f"'{m.SEED}:' || z.doc_id")} % shards as shard
  from z join t7 on z.source is not distinct from t7.source join tq using (place)),
g as (select place, shard, cast(sum(size) as bigint) as shard_size, any_value(source_blocks) as source_blocks, any_value(block) as block from dealt group by 1, 2),
gq as {_quotas('(select *, cast(shard_size as double) as votes from g)', 'place', 'votes', 'source_blocks', 'shard')},
h as (select g.*, cast(ceil(shard_size / block) as bigint) as nb, least(quota, {m.MOST} * cast(ceil(shard_size / block) as bigint)) as q from g join gq using (place, shard)),
i as (select *, case when nb > 0 then q // nb else 0 end as full_, case when nb > 0 then {draw(f"'{m.SEED}:start:' || place || ':' || shard")} % nb else 0 end as first_ from h),
j as (select *, q - full_ * nb as more from i),
b as (select place, shard, full_, first_ * block as b1, least(shard_size, (first_ + more) * block) as b2, greatest(0, first_ + more - nb) * block as b3 from j),
p as (select *, cast(sum(size) over (partition by place, shard order by ord, doc_id, size rows between unbounded preceding and current row) as bigint) as e from dealt)
select doc_id, size, ss as source_size, target, cast(full_ * size + greatest(0, least(b3, e) - (e - size)) + greatest(0, least(b2, e) - greatest(b1, e - size)) as bigint) as taken from p join b using (place, shard)"""


ORACLE_SQL = {"op2_url_filter": _url_sql(), "op6_line_dedup": _LINES, "op10_mixing": _mix_sql()}
