"""Queries over the written index, look-ups, bookkeeping, texts that are served, reports, draws and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import labels, text
from quillmark.operators import draws, engines, ledger, lookup, pools, postings, reports, serving
from quillmark.plans.registry import Tables, query, written_index
from quillmark.session import shared_folder
from quillmark.sources import datasets

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"
_SOURCE_WORDS = "regexp_extract_all(lower(source), '[\\p{L}]+')"

# --- the written index -------------------------------------------------------------------------------------------------

def _starts(words, w):
    return f"len(list_filter({words}, lambda x: starts_with(x, '{w}')))" if len(w) >= postings.LEAST_PREFIX else f"len(list_filter({words}, lambda x: x = '{w}'))"


def _run(words, run):
    tokens = run.split()
    return f"len(list_filter(range(1, len({words}) - {len(tokens) - 2}), lambda i: " + " and ".join(f"{words}[i + {k}] = '{t}'" for k, t in enumerate(tokens)) + "))"


def _ranked_sql(words=(), runs=(), excluded=(), where="true"):
    """Scores of a query over text and source: idf of each clause by the documents that have it, counts weighted 1 and 3."""
    clauses = [*(lambda f, w=w: _starts(f, w) for w in words), *(lambda f, r=r: _run(f, r) for r in runs)]
    counts = ", ".join(f"{c('w')} + 3 * {c('s')} as c{i}" for i, c in enumerate(clauses))
    gone = "".join(f", {_run('w', r)} + {_run('s', r)} as x{i}" for i, r in enumerate(excluded))
    n = ", ".join(f"count_if(c{i} > 0) as n{i}" for i in range(len(clauses)))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), {postings.LEAST_IDF}) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(clauses)))
    test = " and ".join([f"c{i} > 0" for i in range(len(clauses))] + [f"x{i} = 0" for i in range(len(excluded))])
    return f"""with d as (select doc_id, lang, {_WORDS} as w, {_SOURCE_WORDS} as s from documents), b as (select doc_id, lang, len(w) + len(s) as len, {counts}{gone} from d),
z as (select count(*) as n, avg(len) as mean, {n} from b) select doc_id, round({score}, 6) as score from b, z where {test} and {where}"""


def _hits(spark, folder, raw, **how):
    return postings.scored(written_index(spark, folder), spark, raw, **how).withColumn("score", F.round("score", 6))


@query(_ranked_sql(words=("the", "ble")))
def q_index_search(spark, folder):
    """All hits of two words by their beginnings, ranked."""
    return _hits(spark, folder, "the ble")


@query(_ranked_sql(runs=("of the",), excluded=("was",)))
def q_index_phrase(spark, folder):
    """All hits of a run of words, without those of another."""
    return _hits(spark, folder, '"of the" -was')


@query(_ranked_sql(words=("tionb", "src"), where="lang = 'en'"))
def q_index_fields(spark, folder):
    """Words of both fields, weighted, in one language."""
    return _hits(spark, folder, "tionb src", equal={"lang": "en"})


@query(f"select * from ({_ranked_sql(words=('the',))}) order by score desc, doc_id limit 10 offset 10")
def q_index_page(spark, folder):
    """The second page of ten hits."""
    return postings.search(written_index(spark, folder), spark, "the", page=2, limit=10)[0]


@query(f"select token, count(distinct doc_id) as documents from (select doc_id, unnest({_WORDS}) as token from documents union all select doc_id, unnest({_SOURCE_WORDS}) from documents) where starts_with(token, 'tio') group by 1")
def q_index_vocabulary(spark, folder):
    return postings.tokens_like(written_index(spark, folder), spark, "tio")


# --- look-up: parts stand for works, lines for pages, orders for records ----------------------------------------------------


def _works(t):
    mark = F.concat(F.lit("LH "), text.int_to_roman(F.col("p_size")), F.lit(", "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(", "), F.col("p_partkey").cast("string"))
    return t.part.select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("work_id"), F.array(mark).alias("shelfmarks"), F.col("p_size").alias("section"), F.col("p_brand").alias("set_name"), "p_type")


def _pages(t):
    """Eight leaves of each work, both sides."""
    sides = F.explode(F.expr("transform(sequence(0, 15), i -> struct(i as seq, concat(cast(i div 2 + 1 as string), if(i % 2 = 0, 'r', 'v')) as label))"))
    return _works(t).select("work_id", sides.alias("p")).select("work_id", F.concat("work_id", F.lit(":"), F.format_string("%04d", "p.seq")).alias("page_id"), F.col("p.seq").alias("seq"), F.col("p.label").alias("label"))


def _records(t):
    k = F.col("o_orderkey")
    ref = F.struct((k % 8 + 1).cast("string").alias("series"), F.concat(F.lit("0"), (k % 30 + 1).cast("string")).alias("volume"), (k % 500 + 1).cast("string").alias("piece"))
    return t.orders.select(F.concat(F.lit("r"), k.cast("string")).alias("record_id"), F.array(ref).alias("aa_refs"), F.concat(F.lit("w"), (k % 200 + 1).cast("string")).alias("work_id"))


def _lookup(spark, folder, raw):
    t = Tables(spark, folder)
    works, pages, records = _works(t), _pages(t), _records(t)
    links = records.select("record_id", "work_id", F.lit(1.0).alias("confidence"), F.lit("id").alias("method"))
    placed = records.where("substr(record_id, 2) % 2 = 0").select("record_id", "work_id").join(pages.where("seq = 3"), "work_id")
    return lookup.lookup(raw, works=works, pages=pages, shelfmarks=lookup.shelfmark_index(works), editions=lookup.edition_index(records), links=links, placed=placed)


@query("select 'page' as kind, 'w7' as work_id, 'w7:0004' as page_id from part where p_partkey = 7")
def q_lookup_shelfmark(spark, folder):
    """A shelfmark in lower case with leaves: the first page that has them."""
    size = Tables(spark, folder).part.where("p_partkey = 7").first()["p_size"]
    return _lookup(spark, folder, f"lh {size}, 8, 7 Bl. 3–4")


@query("select 'work' as kind, 'w' || p_partkey as work_id, cast(null as varchar) as page_id from part where p_size = (select p_size from part where p_partkey = 7) and p_partkey % 9 = 7 order by 2 limit 100")
def q_lookup_prefix(spark, folder):
    """The beginning of shelfmarks: the works under it."""
    size = Tables(spark, folder).part.where("p_partkey = 7").first()["p_size"]
    return _lookup(spark, folder, f"LH {size}, 8")


@query("""with c as (select o_orderkey as k from orders where o_orderkey % 8 + 1 = 5 and o_orderkey % 30 + 1 = 15 and o_orderkey % 500 + 1 = 45)
select case when k % 2 = 0 and k % 200 + 1 <= (select max(p_partkey) from part) then 'page' else 'work' end as kind, 'w' || (k % 200 + 1) as work_id, case when k % 2 = 0 then 'w' || (k % 200 + 1) || ':0003' end as page_id from c order by 2, 3 limit 100""")
def q_lookup_edition(spark, folder):
    """Records that cite a piece of an edition: their first page, else their work."""
    return _lookup(spark, folder, "A V, 15 N. 45")


@query("select 'page' as kind, 'w5' as work_id, 'w5:0002' as page_id")
def q_lookup_id(spark, folder):
    return _lookup(spark, folder, "w5:0002")


@query("select cast(o_orderkey % 8 + 1 as int) as series, cast(o_orderkey % 30 + 1 as varchar) as volume, cast(o_orderkey % 500 + 1 as varchar) as piece, count(*) as n from orders group by 1, 2, 3")
def q_edition_index(spark, folder):
    return lookup.edition_index(_records(Tables(spark, folder))).groupBy("series", "volume", "piece").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'r' || o_orderkey as record_id, 'w' || (o_orderkey % 200 + 1) as work_id, cast(o_orderkey % 8 + 1 as int) as series, cast(o_orderkey % 30 + 1 as varchar) as volume, cast(o_orderkey % 500 + 1 as varchar) as piece
from orders where (o_orderkey % 8 + 1, o_orderkey % 30 + 1) in ((3, 7), (5, 15), (2, 2))""")
def q_pieces_of_volumes(spark, folder):
    records = _records(Tables(spark, folder))
    free = spark.createDataFrame([(3, "7"), (5, "15"), (2, "2")], "series int, volume string")
    return lookup.pieces_of_volumes(records, records.select("record_id", "work_id", F.lit(1.0).alias("confidence")), free)


@query("""select 'AA ' || case o_orderkey % 8 + 1 when 1 then 'I' when 2 then 'II' when 3 then 'III' when 4 then 'IV' when 5 then 'V' when 6 then 'VI' when 7 then 'VII' else 'VIII' end || ',' || (o_orderkey % 30 + 1) || case when o_orderkey % 3 = 0 then '' else ' N. ' || (o_orderkey % 500 + 1) end as label, count(*) as n from orders group by 1""")
def q_reference_labels(spark, folder):
    k = F.col("o_orderkey")
    label = lookup.reference_label(k % 8 + 1, k % 30 + 1, F.when(k % 3 != 0, k % 500 + 1))
    return Tables(spark, folder).orders.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- bookkeeping ------------------------------------------------------------------------------------------------------------


def _lines(t):
    o = t.orders
    return o.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("line_seq"), F.col("o_orderstatus").alias("text"), F.col("o_totalprice").alias("conf"), F.lit("m1").alias("model"), F.lit(1).alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "la").alias("lang"), F.lit("s").alias("source"))


@query("""select o_custkey as page_id, o_orderkey as line_seq, case when o_orderkey % 3 = 0 then 'new' else o_orderstatus end as text, case when o_orderkey % 3 = 0 then 0.5::double else o_totalprice end as conf,
case when o_orderkey % 3 = 0 then 'm2' else 'm1' end as model, cast(case when o_orderkey % 3 = 0 then 2 else 1 end as int) as run_id, case when o_orderkey % 3 = 0 and o_orderkey % 5 = 0 then 'fr' when o_orderkey % 2 = 0 then 'la' end as lang, 's' as source from orders""")
def q_set_recognition(spark, folder):
    """Readings of a run in place of what lines had; a reading without a language keeps theirs."""
    lines = _lines(Tables(spark, folder))
    readings = lines.where("line_seq % 3 = 0").select("page_id", "line_seq", F.lit("new").alias("text"), F.lit(0.5).alias("conf"), F.expr("case when line_seq % 5 = 0 then 'fr' end").alias("lang"), F.lit(None).cast("string").alias("source"))
    return ledger.recognised(lines, readings, run_id=2, model="m2")


@query("select c_custkey as page_id from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 2 = 1)")
def q_pages_to_do(spark, folder):
    """Pages without a row of a run: what a resumed import still has to read."""
    t = Tables(spark, folder)
    lines = t.orders.select(F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 2).alias("run_id"))
    return ledger.still_to_do(t.customer.select(F.col("c_custkey").alias("page_id")), lines, 1)


@query("""select rule, count(*) as n from (select unnest(list_filter([case when not l_quantity <= 45 then 'quantity' end, case when not l_discount <= 0.08 then 'discount' end, case when not l_linenumber <= 6 then 'line' end], lambda x: x is not null)) as rule from lineitem) group by 1""")
def q_rule_violations(spark, folder):
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08, "line": F.col("l_linenumber") <= 6, "key": F.col("l_orderkey").isNotNull()}
    return ledger.violations(Tables(spark, folder).lineitem, rules)


@query("""select page_id, max(case when rn = 1 then event_type end) as text from (select user_id as page_id, event_type, row_number() over (partition by user_id order by event_id desc) as rn from events where event_type <> 'purchase') group by 1""")
def q_newest_texts(spark, folder):
    """The newest run's text of each line, among the rows that have one."""
    lines = Tables(spark, folder).events.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("text"))
    return ledger.newest_texts(lines, ["page_id"], scoped=True).select("page_id", "text")


@query("""select user_id, event_id, round(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)), 3) as seconds from events""")
def q_epoch_times(spark, folder):
    e = Tables(spark, folder).events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ledger.epochs(e, ["user_id"], "ts").select("user_id", "event_id", F.round("seconds", 3).alias("seconds"))


# --- datasets and served texts -----------------------------------------------------------------------------------------------


@query("""select p.page_id, line_seq, run_id, text, work_id, set_name as "set" from (select user_id % 50 as page_id, cast(ts as date) as d, dayofyear(ts) as line_seq, event_id as run_id, event_type as text, row_number() over (partition by user_id % 50, dayofyear(ts) order by case when event_id % 7 = 0 then 1 else 0 end desc, event_id desc) as rn
from events where event_type <> 'purchase' and event_id % 11 <> 0) p join (select p_partkey as page_id, 'w' || (p_partkey % 10) as work_id from part where p_partkey < 50) g on g.page_id = p.page_id join (select 'w' || x as work_id, 'set' || (x % 3) as set_name from range(0, 8) r(x)) w using (work_id) where rn = 1""")
def q_transcriptions(spark, folder):
    """Current lines with their page and work; rows without text and of the NC bucket do not compete, scoped runs outrank others."""
    t = Tables(spark, folder)
    lines = t.events.select((F.col("user_id") % 50).alias("page_id"), F.dayofyear("ts").cast("long").alias("line_seq"), F.col("event_id").alias("run_id"), F.col("event_id").alias("id"), F.expr("case when event_type <> 'purchase' then event_type end").alias("text"), F.expr("case when event_id % 11 = 0 then 'NC' else 'open' end").alias("license_bucket"))
    at = F.lit("2024-01-01").cast("timestamp")
    runs = t.events.select(F.col("event_id").alias("run_id"), F.lit("recognize").alias("stage"), F.expr("case when event_id % 7 = 0 then 'de' end").alias("scope"), at.alias("started_at"), at.alias("finished_at"))
    pages = t.part.where("p_partkey < 50").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("w"), (F.col("p_partkey") % 10).cast("string")).alias("work_id"), F.lit(None).cast("string").alias("image_service_url"), F.lit("u").alias("image_url"), F.lit("c").alias("canvas_id"))
    works = spark.range(8).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("work_id"), F.concat(F.lit("set"), (F.col("id") % 3).cast("string")).alias("set_name"))
    found = datasets.transcriptions({"lines": lines, "runs": runs, "pages": pages, "works": works})
    return found.select("page_id", "line_seq", "run_id", "text", "work_id", "set")


@query("""select case when l_linenumber % 3 = 0 then 'nc' when l_returnflag <> 'A' then 'open' else 'none' end as deposit, case l_linenumber % 3 when 0 then 'ia+nc' when 1 then 'ia' else '(not recorded)' end as channel, count(*) as n from lineitem group by 1, 2""")
def q_deposit_census(spark, folder):
    """Rows by the deposit that takes them and the channels they came through."""
    source = F.expr("case l_linenumber % 3 when 0 then 'piece=1;channel=ia+nc' when 1 then 'piece=2;channel=ia' else 'piece=3' end")
    lines = Tables(spark, folder).lineitem.select(source.alias("source"), F.expr("case when l_returnflag = 'A' then 'nc' else 'open' end").alias("license_bucket"))
    return datasets.deposit_census(lines, {"ia": "open", "nc": "nc"})


def _turns(t):
    return t.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_seq"), "text", (F.length("text") % 100 / 100).alias("conf"))


@query("""select conv_id as page_id, count(*) as n_lines, string_agg(text, chr(10) order by turn) as text from conversations where coalesce(text, '') <> '' group by 1""")
def q_page_texts(spark, folder):
    return serving.page_texts(_turns(Tables(spark, folder))).select("page_id", "n_lines", "text")


@query("""select cast(c_nationkey as bigint) as work_id, count(*) as pages, count(n) as with_text, cast(coalesce(sum(n), 0) as bigint) as n_lines from customer left join (select conv_id, count(*) as n from conversations where coalesce(text, '') <> '' group by 1) on conv_id = c_custkey group by 1""")
def q_work_headers(spark, folder):
    t = Tables(spark, folder)
    pages = t.customer.select(F.col("c_nationkey").cast("long").alias("work_id"), F.col("c_custkey").alias("page_id"))
    return serving.work_headers(pages, serving.page_texts(_turns(t))).select("work_id", "pages", "with_text", "n_lines")


@query("""with p as (select 'w' || p_partkey as work_id, p_size as section, 'Handschriften zur ' || string_split(p_type, ' ')[1] as phrase from part), c as (select section, phrase, count(*) as k from p group by 1, 2),
b as (select section, phrase, k, sum(k) over (partition by section) as n, row_number() over (partition by section order by k desc, phrase) as rn from c)
select 'LH' as family, section, case when k > 0.5 * n then phrase else 'LH ' || section end as label, cast(n as bigint) as n from b where rn = 1""")
def q_sections(spark, folder):
    """Sections named by what most of their titles say."""
    title = F.concat(F.lit("Handschriften zur "), F.element_at(F.split("p_type", " "), 1), F.lit(" LH "), F.col("section").cast("string"))
    works = _works(Tables(spark, folder)).select("work_id", F.lit("LH").alias("family"), "section", title.alias("title"))
    return serving.sections(works)


@query("""select 'w' || p_partkey || ':' || printf('%04d', s) as page_id, 'https://example.org/page/w' || p_partkey || ':' || printf('%04d', s) || '?run=' || s as permalink, 'w' || p_partkey || ', fol. ' || (s // 2 + 1) || case when s % 2 = 0 then 'r' else 'v' end || ' (model m, run ' || s || '). https://example.org/page/w' || p_partkey || ':' || printf('%04d', s) || '?run=' || s as citation from part, range(0, 16) r(s)""")
def q_citations(spark, folder):
    t = Tables(spark, folder)
    pages = _pages(t)
    works = _works(t).select("work_id", F.lit(None).cast("string").alias("title"))
    return serving.citations(pages, works, pages.select("page_id", F.col("seq").alias("run_id"), F.lit("m").alias("model")), "https://example.org")


# --- reports --------------------------------------------------------------------------------------------------------------------


def _judged(t):
    said = F.expr("case when quality = 1 and toxic = 0 then 'correct' when quality = 1 then 'boundary' when toxic = 1 then 'unreadable' else 'wrong' end")
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", "n_chars", said.alias("verdict"))


_JUDGED = "(select doc_id, lang, source, n_chars, case when quality = 1 and toxic = 0 then 'correct' when quality = 1 then 'boundary' when toxic = 1 then 'unreadable' else 'wrong' end as verdict from labels join documents using (doc_id))"
_PRECISION = "count_if(verdict = 'correct') / nullif(count_if(verdict <> 'unreadable'), 0)"


@query(f"""select lang, count_if(verdict = 'correct') as correct, count_if(verdict = 'boundary') as boundary, count_if(verdict = 'wrong') as wrong, count_if(verdict = 'unreadable') as unreadable, count(*) as judged,
round({_PRECISION}, 6) as precision, round(count_if(verdict in ('correct', 'boundary')) / nullif(count_if(verdict <> 'unreadable'), 0), 6) as usable from {_JUDGED} group by 1""")
def q_verdict_precision(spark, folder):
    made = _judged(Tables(spark, folder)).groupBy("lang").agg(*(m.alias(n) for n, m in reports.verdict_measures(F.col("verdict")).items()))
    return made.drop("unjudged").withColumns({c: F.round(c, 6) for c in ("precision", "usable")})


@query(f"""with p as (select lang, {_PRECISION} as p from {_JUDGED} group by 1), w as (select lang, count(*) as size from documents group by 1) select round(sum(size * p) / sum(size), 6) as weighted from p join w using (lang) where p is not null""")
def q_weighted_precision(spark, folder):
    t = Tables(spark, folder)
    by = _judged(t).groupBy("lang").agg(reports.verdict_measures(F.col("verdict"))["precision"].alias("precision"))
    return reports.weighted_precision(by, t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "lang").withColumn("weighted", F.round("weighted", 6))


@query(f"""select key, value, n, round(precision, 6) as precision from (select 'lang' as key, lang as value, count(*) as n, {_PRECISION} as precision from {_JUDGED} group by lang union all select 'source', source, count(*), {_PRECISION} from {_JUDGED} group by source union all select 'all', null, count(*), {_PRECISION} from {_JUDGED})""")
def q_views_report(spark, folder):
    """One fact table by each of several keys and in all, in one pass."""
    measures = {"n": F.count(F.lit(1)), "precision": F.round(reports.verdict_measures(F.col("verdict"))["precision"], 6)}
    return reports.views(_judged(Tables(spark, folder)), ["lang", "source"], measures)


@query("""select lang, string_agg(source || ':' || n, ',' order by rn) as names from (select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as rn from documents group by 1, 2) where rn <= 5 group by 1""")
def q_ranked_lists(spark, folder):
    made = reports.ranked_lists(Tables(spark, folder).documents, "lang", "source", 5)
    return made.select("lang", F.array_join(F.transform("names", lambda e: F.concat(e["name"], F.lit(":"), e["n"].cast("string"))), ",").alias("names"))


@query("""with m as (select o_custkey % 40 as g, o_orderkey, [case when o_orderkey % 5 = 0 then 'Name' || (o_orderkey % 7) else 'Name' || (o_orderkey % 7) || ', ' || chr(cast(65 + o_orderkey % 2 as int)) || '.' end, 'Other' || (o_orderkey % 3)] as names from orders),
e as (select g, name, count(*) as n from (select g, unnest(list_distinct(names)) as name from m) group by 1, 2), f as (select g, split_part(name, ', ', 1) as name, count(*) as k, any_value(name) as full_ from e where contains(name, ', ') group by 1, 2)
select g, coalesce(case when k = 1 then full_ end, name) as name, cast(sum(n) as bigint) as n from e left join f using (g, name) group by 1, 2""")
def q_name_weights(spark, folder):
    """Names by the records that have them; a bare surname counts for its one fuller form."""
    k = F.col("o_orderkey")
    bare = F.concat(F.lit("Name"), (k % 7).cast("string"))
    names = F.array(F.when(k % 5 == 0, bare).otherwise(F.concat(bare, F.lit(", "), F.when(k % 2 == 0, "A").otherwise("B"), F.lit("."))), F.concat(F.lit("Other"), (k % 3).cast("string")))
    return reports.name_weights(Tables(spark, folder).orders.select((F.col("o_custkey") % 40).alias("g"), names.alias("names"), F.lit(1).alias("n")), "g")


@query("""select l_returnflag, count(*) as n, count_if(l_quantity > 40) as many, count_if(l_discount > 0.08) as cheap, round(count_if(l_quantity > 40) / count(*), 6) as many_share, round(count_if(l_discount > 0.08) / count(*), 6) as cheap_share from lineitem group by 1""")
def q_flag_counts(spark, folder):
    li = Tables(spark, folder).lineitem.select("l_returnflag", labels.flags({"many": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.08}).alias("flags"))
    made = reports.flag_counts(li, ["l_returnflag"], "flags", ["many", "cheap"])
    return made.withColumns({c: F.round(c, 6) for c in ("many_share", "cheap_share")})


@query("""with r as (select lang, n_chars::double as v, row_number() over (partition by lang order by n_chars) as r, count(*) over (partition by lang) as n from documents), q as (select *, unnest([1, 2, 3]) as i from r),
p as (select *, greatest(1, least((n + 1) * i // 4, n - 1)) as lo, (n + 1) * i / 4.0::double - greatest(1, least((n + 1) * i // 4, n - 1)) as f from q), s as (select lang, i, sum(case when r = lo then (1 - f) * v when r = lo + 1 then f * v end) as x from p group by 1, 2)
select lang, round(max(case when i = 1 then x end), 6) as q1, round(max(case when i = 2 then x end), 6) as q2, round(max(case when i = 3 then x end), 6) as q3 from s group by 1""")
def q_quartiles(spark, folder):
    made = reports.quartiles(Tables(spark, folder).documents.select("lang", F.col("n_chars").cast("double").alias("n_chars")), ["lang"], "n_chars")
    return made.select("lang", *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")))


@query("""with s as (select o_orderpriority as model, o_orderkey % 17 as edits, o_orderkey % 97 as chars, o_orderstatus <> 'P' as ok from orders), m as (select *, 'charged' as mode from s union all select *, 'omitted' from s where ok)
select model, mode, count(*) as rows, cast(sum(edits) as bigint) as edits, cast(sum(chars) as bigint) as chars, round(sum(edits) / sum(chars), 6) as cer, round(avg(case when chars > 0 then edits / chars when edits > 0 then 1 else 0 end), 6) as mean_cer from m group by 1, 2""")
def q_pooled_scores(spark, folder):
    """Pooled error rates with failed pages charged and omitted."""
    k = F.col("o_orderkey")
    scores = Tables(spark, folder).orders.select(F.col("o_orderpriority").alias("model"), (k % 17).alias("edits"), (k % 97).alias("chars"), (F.col("o_orderstatus") != "P").alias("ok"))
    made = reports.pooled(reports.charged(scores, F.col("ok")), ["model", "mode"])
    return made.withColumns({c: F.round(c, 6) for c in ("cer", "mean_cer")})


@query("""with x as (select l_suppkey % 3 as reader, l_partkey as unit, l_quantity as q from lineitem) select reader, count(*) as n from x where unit in (select unit from x group by 1 having count(distinct reader) = (select count(distinct reader) from x)) group by 1""")
def q_common_to_all(spark, folder):
    """Rows of the units that every reader has."""
    rows = Tables(spark, folder).lineitem.select((F.col("l_suppkey") % 3).alias("reader"), F.col("l_partkey").alias("unit"))
    return reports.common_to_all(rows, "reader", "unit").groupBy("reader").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select o_orderkey % 5 as r, o_orderkey % 7 % 5 as a, o_orderkey % 3 as b from orders) select count(*) as lines, count_if(a <> b) as disagree, count_if(a <> b and a = r) as a_exact, count_if(a <> b and b = r) as b_exact, count_if(a <> b and (a = r or b = r)) as either_exact, round(count_if(a <> b and (a = r or b = r)) / count_if(a <> b), 6) as either_share from x""")
def q_disagreements(spark, folder):
    k = F.col("o_orderkey")
    made = reports.disagreements(Tables(spark, folder).orders, k % 5, k % 7 % 5, k % 3)
    return made.withColumn("either_share", F.round("either_share", 6))


@query("""with x as (select upper(substr(o_orderpriority, 3)) as a, substr(o_orderpriority, 3) || o_orderstatus as b from orders), s as (select sum(levenshtein(a, b)) / sum(length(a)) as cer, sum(levenshtein(lower(a), lower(b))) / sum(length(a)) as cer_folded, count(*) as lines from x) select round(cer, 6) as cer, round(cer_folded, 6) as cer_folded, lines, round(cer - cer_folded, 6) as tax from s""")
def q_fold_tax(spark, folder):
    """What an error rate loses when case is folded."""
    pairs = Tables(spark, folder).orders.select(F.upper(F.expr("substr(o_orderpriority, 3)")).alias("a"), F.concat(F.expr("substr(o_orderpriority, 3)"), "o_orderstatus").alias("b"))
    return reports.fold_tax(pairs, "a", "b", F.lower).select(*(F.round(c, 6).alias(c) for c in ("cer", "cer_folded", "tax")), "lines")


@query("select l_returnflag, min(case when x < 0.045 then l_linenumber end) as level from (select l_returnflag, l_linenumber, avg(l_discount) as x from lineitem group by 1, 2) group by 1")
def q_break_even(spark, folder):
    levels = Tables(spark, folder).lineitem.groupBy("l_returnflag", F.col("l_linenumber").alias("level")).agg(F.avg("l_discount").alias("x"))
    return reports.break_even(levels, ["l_returnflag"], "level", "x", 0.045)


@query("""with r as (select case event_id % 4 when 0 then 'ok' when 1 then 'empty' else event_type end as status, case when event_id % 3 = 0 then 'refused' end as first_status, event_id % 5 as attempts from events)
select which, status, count(*) as n from (select 'final' as which, status from r union all select 'first', coalesce(first_status, status) from r union all select 'retried', null from r where attempts > 1) group by 1, 2""")
def q_attempts(spark, folder):
    e = F.col("event_id")
    rows = Tables(spark, folder).events.select(F.when(e % 4 == 0, "ok").when(e % 4 == 1, "empty").otherwise(F.col("event_type")).alias("status"), F.when(e % 3 == 0, "refused").alias("first_status"), (e % 5).alias("attempts"))
    return reports.attempts(rows, [])


@query("select event_type, count(*) as n, cast(sum(user_id) as bigint) as user_id_sum, min(user_id) as user_id_min, max(user_id) as user_id_max from events group by 1")
def q_usage_totals(spark, folder):
    return reports.totals(Tables(spark, folder).events, ["event_type"], ["user_id"])


@query("""select l_partkey as page, case when bool_or(g = 'de') and bool_or(g = 'la_fr') then 'both' when bool_or(g = 'de') then 'de' when bool_or(g = 'la_fr') then 'la_fr' else 'other' end as grp from (select l_partkey, case l_suppkey % 9 when 0 then 'de' when 1 then 'la_fr' else 'other' end as g from lineitem) group by 1""")
def q_page_labels(spark, folder):
    g = F.expr("case l_suppkey % 9 when 0 then 'de' when 1 then 'la_fr' else 'other' end")
    return reports.labels_of_pages(Tables(spark, folder).lineitem.select(F.col("l_partkey").alias("page"), g.alias("grp")), "page", "grp")


@query("""with x as (select o_orderkey as record_id, 'test' as reason from orders where o_orderkey % 10 = 0 union select l_orderkey, 'pool' from lineitem where l_partkey % 50 = 0 union select o_orderkey, 'audit' from orders where o_orderkey % 15 = 0)
select record_id, string_agg(reason, ',' order by reason) as reasons from x group by 1""")
def q_holdout(spark, folder):
    """Records to hold out, with every reason: of their own, for a page, for an audited line."""
    t = Tables(spark, folder)
    ids = t.orders.select(F.col("o_orderkey").alias("record_id"))
    own = ids.where("record_id % 10 = 0").withColumn("reason", F.lit("test"))
    pages = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("page_id"), F.lit("pool").alias("reason"))
    made = reports.held_out(own, t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("page_id")), pages, ids.where("record_id % 15 = 0"))
    return made.select("record_id", F.array_join("reasons", ",").alias("reasons"))


@query("""select reason, count(*) as n from (select case when not n_chars >= 200 then 'short' when not n_chars <= 5000 then 'long' when lang is distinct from 'en' then 'language' end as reason from documents) group by 1""")
def q_reason_cascade(spark, folder):
    rules = {"short": F.col("n_chars") >= 200, "long": F.col("n_chars") <= 5000, "language": F.col("lang") == "en"}
    return reports.reasons(Tables(spark, folder).documents, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_brand, cast(arg_max(v, struct_pack(a := w, b := -v)) as double) as value from (select p_brand, round(p_size * 2.0) / 2 as v, sum(length(p_name)) as w from part group by 1, 2) group by 1""")
def q_type_size(spark, folder):
    """The size that most characters are set in."""
    return reports.modes(Tables(spark, folder).part, ["p_brand"], F.round(F.col("p_size") * 2.0) / 2, F.length("p_name")).select("p_brand", "value")


# --- draws ----------------------------------------------------------------------------------------------------------------------


@query("""with r as (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber) - 1 as r, count(*) over (partition by l_partkey) as n from lineitem)
select l_partkey, l_orderkey, l_linenumber from r where n <= 5 or r = 0 or floor(r * 4 / greatest(n - 1, 1)) > floor((r - 1) * 4 / greatest(n - 1, 1))""")
def q_evenly_spaced(spark, folder):
    """Five lines of each part, evenly spaced."""
    li = Tables(spark, folder).lineitem.select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return draws.evenly_spaced(li, ["l_partkey"], "at", 5).drop("at")


@query("""with a as (select lang, source, doc_id, row_number() over (partition by lang, source order by sha256('9:' || doc_id), doc_id) as rd from documents), b as (select *, row_number() over (partition by lang order by rd, sha256('9:' || source), source) as pl from a where rd <= 12) select lang, source, doc_id from b where pl <= 12""")
def q_page_rounds(spark, folder):
    """Twelve documents of each language, one of each source a round."""
    return draws.one_page_a_round(Tables(spark, folder).documents.select("lang", "source", "doc_id"), "lang", "source", "doc_id", 12, seed=9)


@query("""with g as (select o_orderpriority, o_custkey, count(*) as size from orders group by 1, 2), w as (select *, sum(size) over (partition by o_orderpriority order by sha256('4:' || o_custkey), o_custkey) as upto from g) select o_orderpriority, o_custkey, size from w where upto <= 60""")
def q_whole_groups(spark, folder):
    """Whole customers of each priority up to sixty orders."""
    groups = Tables(spark, folder).orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return draws.whole_groups_to(groups, ["o_orderpriority"], "o_custkey", "size", 60, seed=4)


@query("select doc_id from documents order by sha256('11:' || doc_id), doc_id limit 25")
def q_subsample(spark, folder):
    return draws.subsample(Tables(spark, folder).documents.select("doc_id"), "doc_id", 25, seed=11)


@query("select doc_id, row_number() over (order by sha256('13:' || doc_id), doc_id) as place from documents")
def q_shuffled(spark, folder):
    """All documents in a seeded order, numbered."""
    shared_folder(spark)
    return draws.shuffled(Tables(spark, folder).documents.select("doc_id"), "doc_id", seed=13).select("doc_id", F.col("place").cast("long").alias("place"))


# --- labels ---------------------------------------------------------------------------------------------------------------------

_MARKS = ("case p_partkey % 6 when 0 then 'LH 4, ' || p_size when 1 then 'LBr. ' || p_size when 2 then 'LK-MOW ' || p_size when 3 then 'Leibn. Marg. ' || p_size when 4 then 'Ms ' || p_size else ' ' end", "case p_partkey % 6 when 0 then 'LH' when 1 then 'LBr' when 2 then 'LK' when 3 then 'Marg' when 4 then 'other' end")


@query(f"select {_MARKS[1]} as family, count(*) as n from part group by 1")
def q_shelfmark_family(spark, folder):
    return Tables(spark, folder).part.groupBy(labels.shelfmark_family(F.expr(_MARKS[0])).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when lang = 'de' then 'de' when lang in ('la', 'fr') then 'la_fr' else 'other' end as grp, case when n_chars % 2 = 0 then 'de' when lang = 'de' then 'unknown' else lang end as published, count(*) as n from documents group by 1, 2")
def q_piece_groups(spark, folder):
    d = Tables(spark, folder).documents
    return d.groupBy(labels.piece_group(F.col("lang"), F.col("lang")).alias("grp"), labels.published_lang(F.col("n_chars") % 2 == 0, F.col("lang")).alias("published")).agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand as t from part) select p_partkey, case when length(t) <= 20 then t else rtrim(substr(t, 1, case when cut < 12 then 20 else cut end), ' ,;:.-–—/|[(') || '…' end as short from (select *, 21 - coalesce(nullif(strpos(reverse(substr(t, 1, 21)), ' '), 0), 22) as cut from p)""")
def q_truncated(spark, folder):
    p = Tables(spark, folder).part
    return p.select("p_partkey", labels.truncated(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("short"))


@query("select p_partkey, string_split(p_type, ' ')[1] || ', ' || p_size || '|' || p_brand as names from part")
def q_cell_names(spark, folder):
    """Names of a cell, link texts and doubts gone."""
    cell = F.concat(F.element_at(F.split("p_type", " "), 1), F.lit(","), F.col("p_size").cast("string"), F.lit(" ? (KorrespDB) (GND)"), F.col("p_brand"), F.lit(" (?) (GND)u.a."))
    return Tables(spark, folder).part.select("p_partkey", F.array_join(labels.cell_names(cell), "|").alias("names"))


@query("""select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: abs(embedding[i]::double - embedding[i + 32]::double))) / 32, 6) as distance from embeddings""")
def q_thumb_distance(spark, folder):
    e = Tables(spark, folder).embeddings
    return e.select("vec_id", F.round(labels.thumb_distance(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("distance"))


@query("""with x as (select p_partkey, p_size * 40 as w, p_partkey % 60 * 30 + 1 as h from part) select p_partkey, cast(case when greatest(1, w) <= 384 and greatest(1, h) <= 384 then 258 else 258 * ceil(greatest(1, w) / greatest(1.0, floor(least(greatest(1, w), greatest(1, h)) / 1.5))) * ceil(greatest(1, h) / greatest(1.0, floor(least(greatest(1, w), greatest(1, h)) / 1.5))) end as bigint) as tokens from x""")
def q_tile_tokens(spark, folder):
    return Tables(spark, folder).part.select("p_partkey", labels.tile_tokens(F.col("p_size") * 40, F.col("p_partkey") % 60 * 30 + 1).alias("tokens"))


@query("""select fold, count(*) as n from (select case when t = '' then 'unfoldable' when a = t and b = t then 'ambiguous' when a = t then 'v1' when b = t then 'alt' else 'both_wrong' end as fold from (select lower(o_orderpriority) as a, lower(o_orderstatus) as b, case o_orderkey % 5 when 0 then '' when 1 then lower(o_orderpriority) when 2 then lower(o_orderstatus) else 'x' end as t from orders)) group by 1""")
def q_fold_verdict(spark, folder):
    target = F.expr("case o_orderkey % 5 when 0 then '' when 1 then o_orderpriority when 2 then o_orderstatus else 'X' end")
    kind = labels.fold_verdict(F.lower("o_orderpriority"), F.lower("o_orderstatus"), F.lower(target))
    return Tables(spark, folder).orders.groupBy(kind.alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, l_linenumber, case when greatest(a, b, c) >= 0.5 then case when c = greatest(a, b, c) then 'main' when b = greatest(a, b, c) then 'margin' else 'figure' end else 'outside' end as home from (select l_orderkey, l_linenumber, l_discount * 6 as a, l_tax * 7 as b, l_quantity / 100 as c from lineitem)""")
def q_home_group(spark, folder):
    """The zone group that most of a line lies in."""
    shares = F.create_map(F.lit("main"), F.col("l_quantity") / 100, F.lit("margin"), F.col("l_tax") * 7, F.lit("figure"), F.col("l_discount") * 6)
    return Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", labels.home_group(shares).alias("home"))


@query("""select why, count(*) as n from (select case when l_linenumber = 7 then 'no_reading' when l_quantity / 25 < 0.3 then 'ratio_low' when l_quantity / 25 > 1.7 then 'ratio_high' else '' end || case when l_discount < 0.02 then '+conf_low' else '' end as why from lineitem) group by 1""")
def q_outside_band(spark, folder):
    why = labels.outside_band(F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 25), F.col("l_discount"), low=F.lit(0.3), high=F.lit(1.7), least=F.lit(0.02))
    shown = F.concat(F.coalesce(F.get(F.filter(why, lambda x: x != "conf_low"), 0), F.lit("")), F.when(F.array_contains(why, "conf_low"), "+conf_low").otherwise(""))
    return Tables(spark, folder).lineitem.groupBy(shown.alias("why")).agg(F.count(F.lit(1)).alias("n"))




# --- pools and readings ---------------------------------------------------------------------------------------------------------


@query("""with p as (select o_custkey as rec, o_orderkey as pos, o_orderkey % 8 as s, cast(o_orderkey % 5 as varchar) as v, 'p' || o_orderkey as piece from orders), r as (select rec, pos, s, v, case when pos % 2 = 0 then 'q' || rec else '' end as piece, case pos % 3 when 0 then 'ia' when 1 then 'gw' end as ch from p where rec % 3 <> 0 and pos % 4 > 1),
f as (select * from (select *, row_number() over (partition by rec order by pos) as rn from r) where rn = 1), c as (select rec, string_agg(distinct ch, '+' order by ch) as ch from r group by 1),
m as (select p.rec, p.s, p.v, coalesce(nullif(f.piece, ''), p.piece) as piece, c.ch, row_number() over (partition by p.rec order by p.pos) as rn from p join f on p.rec = f.rec and p.s = f.s and p.v = f.v join c on c.rec = p.rec),
a as (select rec, s, v, piece, row_number() over (partition by rec order by pos) as rn from p where rec not in (select rec from r))
select rec as record_id, s as series, v as volume, piece, ch as channel from m where rn = 1 union all select rec, s, v, piece, null from a where rn = 1""")
def q_text_pieces(spark, folder):
    """The piece of each record that its text came from."""
    k = F.col("o_orderkey")
    pieces = Tables(spark, folder).orders.select(F.col("o_custkey").alias("record_id"), k.alias("pos"), (k % 8).alias("series"), (k % 5).cast("string").alias("volume"), F.concat(F.lit("p"), k.cast("string")).alias("piece"))
    given = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("q"), F.col("record_id").cast("string"))).otherwise("")
    refs = pieces.where("record_id % 3 <> 0 and pos % 4 > 1").select("record_id", "pos", "series", "volume", given.alias("piece"), F.expr("case pos % 3 when 0 then 'ia' when 1 then 'gw' end").alias("channel"))
    return pools.text_pieces(pieces, refs)


@query("""with d as (select o_custkey as line_id, cast(o_orderdate as date) as dt, o_orderkey as cand, case when o_orderkey % 4 = 0 then 'both_rejected' else 'converged' end as r from orders),
x as (select *, r = 'converged' as c, row_number() over (partition by line_id, r = 'converged' order by dt desc, cand) as rk, max(dt) over (partition by line_id, r = 'converged') as top, row_number() over (partition by line_id, dt, r = 'converged' order by cand) as ag from d)
select action, count(*) as n from (select case when not c then case when ag = 1 then 'queue' else 'queued_already' end when rk > 1 then case when dt = top then 'duplicate_in_pack' else 'superseded_in_pack' end when line_id % 7 = 0 then 'no_machine_row' when line_id % 5 = 0 then 'already_imported' else 'insert' end as action from x) group by 1""")
def q_decision_plan(spark, folder):
    """What an import of decisions would do, by action."""
    t = Tables(spark, folder)
    made = t.orders.select(F.col("o_custkey").alias("line_id"), F.to_date("o_orderdate").alias("decided_at"), F.expr("case when o_orderkey % 4 = 0 then 'both_rejected' else 'converged' end").alias("retirement"), F.col("o_orderkey").alias("cand_id"), F.lit("t").alias("text"))
    machine = made.where("line_id % 7 <> 0").select("line_id")
    return pools.decision_plan(made, machine, made.where("line_id % 5 = 0").select("line_id", "decided_at")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""select i.p_partkey as name, arg_min(j.p_partkey, struct_pack(a := abs(i.p_retailprice - j.p_retailprice), b := j.p_partkey)) as page_id, round(min(abs(i.p_retailprice - j.p_retailprice)), 6) as distance from part i join part j on i.p_size = j.p_size and i.p_brand = j.p_brand and i.p_partkey % 10 = 0 and j.p_partkey % 10 <> 0 group by 1 having min(abs(i.p_retailprice - j.p_retailprice)) <= 500""")
def q_nearest_image(spark, folder):
    """The page of an image's size that looks most like it."""
    rows = Tables(spark, folder).part.select(F.col("p_size").alias("width"), F.col("p_brand").alias("height"), "p_partkey", F.col("p_retailprice").alias("thumb"))
    images = rows.where("p_partkey % 10 = 0").withColumnRenamed("p_partkey", "name")
    pairs = pools.same_size(images, rows.where("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "page_id"))
    return pools.nearest_image(pairs, "name", "page_id", F.abs(F.col("thumb") - F.col("page_thumb")), 500.0).withColumn("distance", F.round("distance", 6))


@query("""with l as (select c_custkey as id, c_custkey % 260 + 1 as part, c_custkey % 12 as lo, c_custkey % 12 + c_custkey % 3 as hi, c_custkey % 4 = 0 as shared from customer),
j as (select l.id, p.p_partkey, x.n from l join part p on p.p_partkey = l.part join (select range as n from range(1, 9)) x on x.n between l.lo and l.hi where l.lo > 0)
select reason, count(*) as n from (select case when l.part not in (select p_partkey from part) then 'no_work' when not exists (select 1 from j where j.id = l.id) then 'no_canvas' when (select sum(n) from j where j.id = l.id and j.n > 4) is null then 'no_lines' when shared then 'shared' else 'placed' end as reason from l) group by 1""")
def q_placed_letters(spark, folder):
    """Letters by why they cannot be placed."""
    t = Tables(spark, folder)
    k = F.col("c_custkey")
    span = F.when(k % 12 > 0, text.folio_span(F.concat((k % 12).cast("string"), F.lit("-"), (k % 12 + k % 3).cast("string"))))
    letters = t.customer.select(k.alias("letter_id"), (k % 260 + 1).cast("string").alias("key"), span.alias("span"), (k % 4 == 0).alias("shared"))
    works = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("work_id"))
    pages = _pages(t)
    lines = pages.where("seq >= 8").select("page_id", F.lit(3).alias("n_lines"))
    return pools.placed_letters(letters, works, pages, lines).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus || 'x' when o_orderkey % 3 = 0 then 'read' end as machine_text, round(case when o_orderkey % 2 = 0 then 3.0::double / 2 when o_orderkey % 3 = 0 then 3.0::double / 4 end, 6) as ratio from orders""")
def q_machine_text(spark, folder):
    """The text that each line was aligned on, and the ratio of lengths."""
    o = Tables(spark, folder).orders
    ref = F.col("o_orderkey").alias("ref")
    lines = o.select("o_orderkey", ref, F.when(F.col("o_orderkey") % 2 == 1, "r").alias("reader"), F.lit("abc").alias("text"))
    stored = o.select(ref, F.concat("o_orderstatus", F.lit("x")).alias("text"))
    read = o.where("o_orderkey % 3 = 0").select(ref, F.lit("r").alias("reader"), F.lit("read").alias("text"))
    return pools.with_machine_text(lines, stored, read).select("o_orderkey", "machine_text", F.round("ratio", 6).alias("ratio"))


@query("select lang, doc_id, (row_number() over (partition by lang order by doc_id) - 1) // 25 as piece from documents")
def q_chunks(spark, folder):
    """Documents of each language in runs of twenty-five."""
    return pools.chunked(Tables(spark, folder).documents.select("lang", "doc_id"), ["lang"], "doc_id")


@query("select p_brand, count(*) as pages, cast(sum(p_size * 10) as bigint) as input_tokens, count(*) * 500 as output_tokens, round(sum(p_size * 10) * 3.0 / 1e6 + count(*) * 500 * 15.0 / 1e6, 9) as cost from part group by 1")
def q_read_plan(spark, folder):
    """What reading pages would cost, without a call."""
    made = engines.read_plan(Tables(spark, folder).part, ["p_brand"], input_tokens=F.col("p_size") * 10, output_tokens=500, input_price=3.0, output_price=15.0)
    return made.withColumn("cost", F.round("cost", 9))


@query("select lang, doc_id from (select lang, doc_id, sum(n_chars) over (order by doc_id) as upto from documents) where upto <= 100000")
def q_within_budget(spark, folder):
    """The first documents whose characters together stay within a budget."""
    return engines.within_budget(Tables(spark, folder).documents.select("lang", "doc_id", "n_chars"), ["doc_id"], "n_chars", 100_000).select("lang", "doc_id")
