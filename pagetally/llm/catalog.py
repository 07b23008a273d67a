"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from pagetally.llm import (
    decontaminate,
    filter_audit,
    katz,
    lines,
    mixing,
    passages,
    quality,
    shards,
    simhash,
    tools,
    topk,
    toxicity,
    vector_codes,
)
from pagetally.llm.common import table


def op1_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_katz(spark, sf_dir):
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixture(spark, sf_dir):
    return mixing.poisson_mixture(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


# Calls and results as the turns of the given conversations tell them; the same text runs in
# Spark and DuckDB. Every assistant turn calls a tool, the turn after it is the result.
TOOL_CALLS = """
select conv_id, turn, 0 as call_no, concat('c', cast(turn as string)) as call_id,
  case when n % 29 = 0 then 'fetch' when turn % 3 = 0 then 'lookup' else 'search' end as name,
  case when n % 29 <> 0 and turn % 3 = 0
    then concat('{"id": ', case when n % 13 = 0 then '"x"' else cast(n as string) end, after, '}')
    else concat('{ "query": "', md5(body), '",  "limit": ', cast(n % 60 as string), after, ' }') end as arguments
from (select *, case when used is null then '' else concat(', "after": {"$call": "c', cast(used as string), '"}') end as after
  from (select conv_id, turn, coalesce(text, '') as body, length(coalesce(text, '')) as n,
      case when turn % 22 = 21 then turn when turn % 10 = 9 then turn + 1000
           when turn % 8 >= 2 then turn - 2 else null end as used
    from {conversations} where role = 'assistant') a) b"""
TOOL_RESULTS = """
select conv_id, turn, concat('c', cast(turn - 1 as string)) as call_id, text as content
from {conversations} where role <> 'assistant'"""
TOOL_SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "after": {"type": "string"},
        },
        "required": ["query"],
        "additionalProperties": False,
    },
    "lookup": {
        "type": "object",
        "properties": {"id": {"type": "integer"}, "after": {"type": "string"}},
        "required": ["id"],
        "additionalProperties": False,
    },
}


def op8_tools(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    name = "llm_conversations_" + uuid.uuid4().hex[:8]
    turns.createOrReplaceTempView(name)
    calls, results = (spark.sql(text.replace("{conversations}", name)) for text in (TOOL_CALLS, TOOL_RESULTS))
    return tools.link_calls(calls, results, TOOL_SCHEMAS)


def op9_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_shards(spark, sf_dir):
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        shards.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_codes(spark, sf_dir):
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)
    rows = vector_codes.with_group_error(found.rows, "label", name="label_error")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_filters(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk,
        op2_simhash,
        op3_katz,
        op4_decontaminate,
        op5_mixture,
        op6_quality,
        op7_lines,
        op8_tools,
        op9_passages,
        op10_toxicity,
        op11_shards,
        op12_codes,
        op13_filters,
        pipeline,
    )
}

def _plain(text: str) -> str:
    return text.replace("{conversations}", "conversations").replace(" as string", " as varchar")


OP1_SQL = """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, q.r, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as k from scored)
select query_id, cast(k as integer) as rank, vec_id, score from ranked where k <= 5"""

_ITEM_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_ITEM_WORDS}, []) as w from documents),
b as (select item_id, {_ITEM_WORDS} as w from benchmark where item_id is not null and text is not null),
windows as (
  select distinct item_id, w[i : i + least(10, len(w)) - 1] as win
  from b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) g(i) where len(w) > 0),
sizes as (select distinct len(win) as k from windows),
places as (
  select r, i, k, w[i : i + k - 1] as win
  from d, sizes, unnest(generate_series(1, greatest(len(w) - k + 1, 0))) g(i)),
found as (select r, i, k, item_id from places join windows using (win)),
hits as (select r, count(distinct p) as n from found, unnest(generate_series(i, i + k - 1)) g(p) group by r),
named as (
  select r, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names
  from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hits.n, 0) as bigint) as n_hit,
  cast(coalesce(named.n, 0) as bigint) as n_items, sha256(coalesce(named.names, '')) as items_sha256,
  coalesce(hits.n, 0) > 0 as contaminated
from d left join hits using (r) left join named using (r)"""

OP5_SQL = """
with s as (select source, count(*) as n from documents group by source),
rates as (select source, (select sum(n) from s) / ((select count(*) from s) * cast(n as double)) as rate from s),
parts as (select source, greatest(1, ceil(rate / 200.0)) as m, rate / greatest(1, ceil(rate / 200.0)) as lam from rates),
pmf as (
  select source, m, k, exp(k * ln(lam) - lam - lgamma(k + 1)) as p
  from parts, unnest(generate_series(0, cast(floor(lam + 12 * sqrt(lam) + 40) as bigint))) g(k)),
cdf as (select source, m, k, sum(p) over (partition by source order by k) as c from pmf),
drawn as (
  select d.*, cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || p), 1, 13) as bigint) / 4503599627370496.0 as u, p
  from (select *, row_number() over () as r from documents) d join parts on d.source is not distinct from parts.source, unnest(generate_series(0, cast(m as bigint) - 1)) g(p)),
counted as (
  select r, doc_id, text, lang, d.source, n_chars, count(*) filter (c <= u) as copies
  from drawn d join cdf on d.source is not distinct from cdf.source group by all)
select doc_id, text, lang, source, n_chars, cast(i as integer) as "copy",
  md5('order:17:' || coalesce(cast(doc_id as varchar), '') || ':' || i) as shuffle_key
from counted, unnest(generate_series(0, copies - 1)) g(i) where copies > 0"""

OP7_SQL = """
with l as (
  select doc_id, i - 1 as no, string_split(text, chr(10))[i] as line, string_split(text, chr(10)) as parts
  from documents, unnest(generate_series(1, len(string_split(text, chr(10))))) g(i)),
w as (
  select doc_id, no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from l),
firsts as (
  select line, any_value(w) as w, min({'d': doc_id, 'n': no}) as place from w where len(w) > 0 group by line),
swapped as (
  select line, place, len(w) as n, i, w[1 : i - 1] || w[i + 1 :] as v
  from firsts, unnest(generate_series(1, len(w))) g(i) where len(w) >= 5),
same as (select n, i, v, min(place) as place from swapped group by n, i, v),
near as (
  select s.line from swapped s join same m using (n, i, v) where m.place < s.place
  union select a.line from swapped a join firsts b on a.v = b.w where b.place < a.place
  union select b.line from swapped a join firsts b on a.v = b.w where a.place < b.place),
gone as (
  select w.doc_id, w.no from w join firsts f using (line)
  where len(w.w) > 0 and ({'d': w.doc_id, 'n': w.no} <> f.place or w.line in (select line from near)))
select d.doc_id, cast(count(*) filter (g.no is not null) as bigint) as n_removed,
  coalesce(string_agg(l.line, chr(10) order by l.no) filter (g.no is null), '') as text
from documents d join l using (doc_id) left join gone g on l.doc_id = g.doc_id and l.no = g.no
group by d.doc_id"""

OP8_SQL = """
with recursive calls as (CALLS), results as (RESULTS),
first as (
  select distinct on (conv_id, call_id) *, regexp_extract(arguments, '"c(-?[0-9]+)"', 1) as ref
  from calls where conv_id is not null and turn is not null order by conv_id, call_id, turn, call_no, name, arguments),
used as (select *, case when ref = '' then null else 'c' || ref end as on_call from first),
known as (select u.*, t.call_id as target from used u left join first t on u.conv_id = t.conv_id and u.on_call = t.call_id),
lv as (
  select conv_id, call_id, 0 as level from known where target is null
  union all select k.conv_id, k.call_id, lv.level + 1 from known k join lv on k.conv_id = lv.conv_id and k.target = lv.call_id),
answers as (select distinct on (conv_id, call_id) conv_id, call_id, content from results order by conv_id, call_id, turn, content),
joined as (
  select k.*, lv.level, a.content, a.call_id is not null as answered,
    cast(regexp_extract(arguments, '"limit": ([0-9]+)', 1) as varchar) as lim, regexp_extract(arguments, '"query": "([^"]*)"', 1) as q,
    regexp_extract(arguments, '"id": ("x"|[0-9]+)', 1) as num,
    case when ref = '' then '' else '"after":{"$call":"c' || ref || '"},' end as aft
  from known k left join lv using (conv_id, call_id) left join answers a using (conv_id, call_id)),
judged as (
  select *, case when name = 'fetch' then 'unknown tool'
      when name = 'search' and cast(lim as int) < 1 then 'limit: beyond minimum'
      when name = 'search' and cast(lim as int) > 50 then 'limit: beyond maximum'
      when name = 'lookup' and num = '"x"' then 'id: not integer' end as problem from joined),
told as (
  select *, case when level is null then 'circular' when problem is not null then 'invalid'
      when on_call is not null and target is null then 'dangling' when not answered then 'unanswered' else 'ok' end as status from judged)
select conv_id, cast(level as integer) as level, turn, cast(call_no as integer) as call_no, call_id, status,
  case when status = 'invalid' then problem end as detail,
  '{"arguments":{' || aft || case when name = 'lookup' then '"id":' || num else '"limit":' || lim || ',"query":"' || q || '"' end
    || '},"id":"' || call_id || '","name":"' || name || '",'
    || case when status = 'unanswered' then '' else '"result":' || coalesce(cast(to_json(content) as varchar), 'null') || ',' end
    || '"status":"' || status || '"}' as json
from told""".replace("CALLS", _plain(TOOL_CALLS)).replace(
    "RESULTS", _plain(TOOL_RESULTS)
)

# A row lies in the shard that holds the middle of its bytes when all rows are laid end to end.
OP11_SQL = """
with bits as (
  select cast(i as bigint) as i,
    list_reduce([cast(i as bigint)] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from range(256) r(i)),
tab as (select list(c order by i) as tab from bits),
d as (
  select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) + 8 as size,
    md5(coalesce(text, '')) || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 16) as k
  from documents),
placed as (
  select *, sum(size) over (order by k rows unbounded preceding) - size as below, sum(size) over () as total
  from d),
dealt as (select *, cast(floor(cast(24 * (2 * below + size) as bigint) // cast(2 * total as bigint)) as integer) as shard from placed)
select doc_id, cast(size as bigint) as size,
  xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: cast('0x' || b as bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
  'bytes' as law, shard, row_number() over (partition by shard order by k) - 1 as slot, cast(null as integer) as grown_shard
from dealt, tab"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    def assigned(books: str) -> str:
        return f"""select r, p, any_value(v) as v, min(struct_pack(d := d, j := j)) as best from (
          select c.r, c.p, c.v, b.j, list_sum(list_transform(list_zip(c.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d
          from cuts c join {books} b on c.p = b.p) group by r, p"""

    steps = [
        f"""kept as (
      select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label,
        list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as e
      from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""cuts as materialized (
      select r, p, e[len(e) // {parts} * p + 1 : len(e) // {parts} * (p + 1)] as v from kept, range({parts}) t(p))""",
        f"b0 as materialized (select p, r - 1 as j, v from cuts where r <= {entries})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({assigned(f'b{i}')})")
        steps.append(f"""m{i} as (
      select p, j, list(mean order by pos) as v from (
        select p, best.j as j, pos, cast(floor(sum(v[pos]) / count(*)) as bigint) as mean
        from a{i}, unnest(range(1, len(v) + 1)) t(pos) group by p, best.j, pos) group by p, j)""")
        steps.append(f"""b{i + 1} as materialized (
      select b.p, b.j, coalesce(m.v, b.v) as v from b{i} b left join m{i} m on b.p = m.p and b.j = m.j)""")
    steps.append(f"last as materialized ({assigned(f'b{rounds}')})")
    steps.append("""coded as (
      select r, string_agg(lpad(to_hex(best.j), 2, '0'), '' order by p) as code, cast(sum(best.d) as bigint) as error from last group by r)""")
    steps.append(f"digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, j)) as sha from b{rounds})")
    return f"""with {", ".join(steps)}
    select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256
    from kept join coded using (r), digest"""


OP12_SQL = _op12_sql()

OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
marks as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
flagged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end as fails
  from d left join marks on d.doc_id = marks.doc_id),
masks as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from flagged group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
perms as (
  select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, s, substr(o, s, 1) as f, substr(o, 1, s - 1) as earlier from perms, range(1, 6) t(s)),
rows_ as (
  select part, o, s, f,
    sum(n) filter (translate(fails, earlier || f, '') = fails) as kept,
    sum(n) filter (contains(fails, f) and translate(fails, earlier, '') = fails) as removed,
    sum(n) filter (contains(fails, f) and translate(fails, earlier, '') <> fails) as redundant,
    sum(n) filter (fails = f) as unique_fails,
    sum(good) filter (contains(fails, f) and translate(fails, earlier, '') = fails) as good_lost,
    sum(toxic) filter (contains(fails, f) and translate(fails, earlier, '') = fails) as toxic_lost
  from masks, steps group by part, o, s, f)
select part, o as filter_order, cast(s as integer) as step, cast(coalesce(kept, 0) as bigint) as kept,
  cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) as shapley
from rows_"""

SQL = {
    "op1_topk": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_mixture": OP5_SQL,
    "op7_lines": OP7_SQL,
    "op8_tools": OP8_SQL,
    "op11_shards": OP11_SQL,
    "op12_codes": OP12_SQL,
    "op13_filters": OP13_SQL,
}
