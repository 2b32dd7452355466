"""Queries over versions, merges, links, reports and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import catalog
from quillmark.operators import evaluation, links, sampling, sequences, versions
from quillmark.plans.registry import Tables, query
from quillmark.session import shared_folder

# Events stand for versioned lines: a user and day is a line, a type is a stage, an event is a run.
_STAGE = "case event_type when 'purchase' then 2 when 'click' then 1 else 0 end"
_EXACT_MEAN = "round(cast(sum(cast(value as decimal(18,2))) as double) / count(*), 4)"


def _lines(t):
    return t.events.select("user_id", F.to_date("ts").alias("day"), F.expr(_STAGE).alias("prec"), "event_id", "event_type", "value")


_CURRENT_SQL = f"""select * exclude (rn) from (select user_id, cast(ts as date) as day, {_STAGE} as prec, event_id, event_type, value,
  row_number() over (partition by user_id, cast(ts as date) order by {_STAGE} desc, event_id desc) as rn from events {{where}}) where rn = 1"""


@query(f"select user_id, count(*) as n, {_EXACT_MEAN} as mean_value from ({_CURRENT_SQL.format(where='')}) where value is not null group by user_id")
def q_current_row_summary(spark, folder):
    rows = versions.current_rows(_lines(Tables(spark, folder)), ["user_id", "day"], [F.col("prec").desc(), F.col("event_id").desc()])
    return rows.where("value is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.expr(_EXACT_MEAN).alias("mean_value"))


@query(f"""with l as (select user_id, cast(ts as date) as day, {_STAGE} as prec, event_id, value from events)
select user_id, day, event_id, value from l where not exists (select 1 from l b where b.user_id = l.user_id and b.day = l.day and (b.prec > l.prec or (b.prec = l.prec and b.event_id > l.event_id)))""")
def q_current_row_antijoin(spark, folder):
    lines = _lines(Tables(spark, folder)).select("user_id", "day", "prec", "event_id", "value")
    return versions.current_by_antijoin(lines, ["user_id", "day"], ["prec", "event_id"]).select("user_id", "day", "event_id", "value")


@query(f"select user_id, day, event_id, event_type, value from ({_CURRENT_SQL.format(where='where event_id <= 5000')})")
def q_as_of_read(spark, folder):
    rows = versions.current_rows(_lines(Tables(spark, folder)), ["user_id", "day"], [F.col("prec").desc(), F.col("event_id").desc()], as_of=F.col("event_id") <= 5000)
    return rows.select("user_id", "day", "event_id", "event_type", "value")


@query("select cast(sum(n) as bigint) as total, count(*) as current, cast(sum(n) - count(*) as bigint) as superseded from (select count(*) as n from events group by user_id, cast(ts as date))")
def q_superseded_count(spark, folder):
    return versions.superseded(_lines(Tables(spark, folder)), ["user_id", "day"])


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def q_status_histogram(spark, folder):
    return Tables(spark, folder).orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type as model, count(*) as n, count(value) as with_value from events group by 1 order by n desc")
def q_models_by_lines(spark, folder):
    e = Tables(spark, folder).events
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


@query("""select count_if(value < 20) as under_20, count_if(value >= 20 and value < 50) as from_20, count_if(value >= 50 and value < 80) as from_50,
count_if(value >= 80) as from_80, count_if(value is null) as none from events""")
def q_conf_bands(spark, folder):
    v = F.col("value")
    bands = {"under_20": v < 20, "from_20": (v >= 20) & (v < 50), "from_50": (v >= 50) & (v < 80), "from_80": v >= 80, "none": v.isNull()}
    return Tables(spark, folder).events.agg(*(F.count_if(c).alias(k) for k, c in bands.items()))


@query("""select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as rn
from events group by user_id, event_type) where rn = 1""")
def q_majority_label(spark, folder):
    return sequences.first_mode(Tables(spark, folder).events, ["user_id"], "event_type", "event_id")


_HALVES = """with old as (select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderkey % 3 <> 0),
new as (select o_orderkey, case when o_orderkey % 2 = 0 then 'X' end as o_orderstatus, o_totalprice + 1 as o_totalprice from orders where o_orderkey % 3 <> 1)"""


def _halves(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = t.orders.where("o_orderkey % 3 <> 1").select("o_orderkey", F.expr("case when o_orderkey % 2 = 0 then 'X' end").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return old, new


@query(f"""{_HALVES} select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus,
coalesce(o.o_totalprice, n.o_totalprice) as o_totalprice, o.o_orderpriority from old o full join new n on o.o_orderkey = n.o_orderkey""")
def q_upsert_coalesce(spark, folder):
    old, new = _halves(Tables(spark, folder))
    return versions.upsert_coalesce(old, new, ["o_orderkey"], keep=["o_totalprice"])


@query(f"""{_HALVES} select o_orderkey, o_totalprice from old where o_orderkey not in (select o_orderkey from new) union all select o_orderkey, o_totalprice from new""")
def q_upsert_overwrite(spark, folder):
    old, new = _halves(Tables(spark, folder))
    return versions.upsert_overwrite(old.select("o_orderkey", "o_totalprice"), new.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("""select l_orderkey, price, side from (select *, row_number() over (partition by l_orderkey order by price desc, side) as rn from (
select l_orderkey, max(l_extendedprice) as price, 0 as side from lineitem where l_linenumber <= 2 group by 1 union all
select l_orderkey, max(l_extendedprice) as price, 1 as side from lineitem where l_linenumber > 2 group by 1)) where rn = 1""")
def q_upsert_conditional(spark, folder):
    li = Tables(spark, folder).lineitem
    side = lambda test, n: li.where(test).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price")).withColumn("side", F.lit(n))
    return versions.upsert_if_higher(side("l_linenumber <= 2", 0), side("l_linenumber > 2", 1), ["l_orderkey"], "price")


@query("""select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_quantity desc, cast(l_orderkey as varchar), l_linenumber) as rn from lineitem) where rn = 1""")
def q_contested_ownership(spark, folder):
    li = Tables(spark, folder).lineitem
    won = versions.replace_owned(li, line="l_partkey", confidence="l_quantity", owner="l_orderkey", ties=["l_linenumber"])
    return won.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("""with ids as (select distinct o_orderkey as record, o_custkey as work from orders),
keys as (select distinct o.o_orderkey as record, c.c_custkey as work from orders o join customer c on o.o_custkey // 8 = c.c_custkey // 8 and c.c_mktsegment = 'BUILDING')
select record, work, 'id' as method, 1.0::double as confidence from ids union all
select record, work, 'key', 0.7::double from keys k where not exists (select 1 from ids i where i.record = k.record and i.work = k.work)""")
def q_two_method_crosswalk(spark, folder):
    """Every order's link by id, and by a key of eight customers; a key's customers do not grow with the table."""
    t = Tables(spark, folder)
    ids = t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("work"))
    cell = t.customer.where("c_mktsegment = 'BUILDING'").select(F.expr("c_custkey div 8").alias("k"), F.col("c_custkey").alias("work"))
    keys = t.orders.select(F.col("o_orderkey").alias("record"), F.expr("o_custkey div 8").alias("k")).join(cell, "k")
    return links.two_method_links(ids, keys, "record", "work")


@query("select o_custkey as record, max(o_totalprice) as confidence, arg_min(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) as work from orders group by 1")
def q_best_link(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("work"), F.col("o_totalprice").alias("confidence"))
    return links.best_link(rows, "record", "work")


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by 1")
def q_left_join_counts(spark, folder):
    t = Tables(spark, folder)
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def q_semi_join(spark, folder):
    t = Tables(spark, folder)
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def q_anti_join(spark, folder):
    t = Tables(spark, folder)
    return links.unresolved(t.customer.select("c_custkey", "c_name"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""with a as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 4 <> 0),
b as (select o_orderkey, case when o_orderkey % 7 = 0 then 'Z' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_orderkey % 5 <> 0),
j as (select a.o_orderkey as ka, b.o_orderkey as kb, a.o_orderstatus as sa, b.o_orderstatus as sb, a.o_orderpriority as pa, b.o_orderpriority as pb from a full join b on a.o_orderkey = b.o_orderkey)
select field, kind, count(*) as n from (
select 'o_orderstatus' as field, case when ka is null then 'only_new' when kb is null then 'only_old' when sa is not distinct from sb then 'equal' else 'changed' end as kind from j union all
select 'o_orderpriority', case when ka is null then 'only_new' when kb is null then 'only_old' when pa is not distinct from pb then 'equal' else 'changed' end from j) group by 1, 2""")
def q_full_outer_compare(spark, folder):
    o = Tables(spark, folder).orders
    a = o.where("o_orderkey % 4 <> 0")
    b = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 7 = 0 then 'Z' else o_orderstatus end"))
    return links.compare_tables(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


_SPANS = "select l_orderkey, l_suppkey % 40 as lo, l_suppkey % 40 + cast(l_quantity as int) % 5 as hi, l_linenumber from lineitem"


@query(f"""with s as ({_SPANS}), p as (select l_orderkey, l_linenumber as seq, l_partkey % 45 as folio from lineitem)
select p.l_orderkey, p.seq, p.folio, s.l_linenumber as span, s.lo, s.hi from p join s on p.l_orderkey = s.l_orderkey and p.folio between s.lo and s.hi""")
def q_range_place(spark, folder):
    li = Tables(spark, folder).lineitem
    spans = li.selectExpr("l_orderkey", "l_suppkey % 40 as lo", "l_suppkey % 40 + cast(l_quantity as int) % 5 as hi", "l_linenumber as span")
    points = li.selectExpr("l_orderkey", "l_linenumber as seq", "l_partkey % 45 as folio")
    return links.in_range(points, spans, on=["l_orderkey"], at="folio", lo="lo", hi="hi", width=8).select("l_orderkey", "seq", "folio", "span", "lo", "hi")


@query("""with y as (select o_custkey, o_orderkey, epoch(o_orderdate)::bigint // 86400 as lo, epoch(o_orderdate)::bigint // 86400 + o_orderkey % 60 as hi from orders)
select a.o_custkey, a.o_orderkey as one, b.o_orderkey as other from y a join y b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.lo <= b.hi and b.lo <= a.hi""")
def q_year_interval_overlap(spark, folder):
    o = Tables(spark, folder).orders
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    a = o.select("o_custkey", F.col("o_orderkey").alias("one"), day.alias("lo"), (day + F.col("o_orderkey") % 60).alias("hi"))
    b = a.select("o_custkey", F.col("one").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    found = links.overlapping(a, b, on=["o_custkey"], a_span=("lo", "hi"), b_span=("lo2", "hi2"), width=60)
    return found.where("one < other").select("o_custkey", "one", "other")


@query("""select e.event_id, o.o_orderkey as last_order from (select event_id, user_id, event_id as at from events) e
asof left join (select o_custkey % 150 as user_id, o_orderkey, o_orderkey as at from orders) o on e.user_id = o.user_id and e.at >= o.at""")
def q_as_of_join(spark, folder):
    t = Tables(spark, folder)
    left = t.events.select("event_id", "user_id", F.col("event_id").alias("at"))
    right = t.orders.select((F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderkey"), F.col("o_orderkey").alias("at2"))
    found = links.nearest_before(left, right, on=["user_id"], left_at="at", right_at="at2", values=["o_orderkey"])
    return found.select("event_id", F.col("o_orderkey").alias("last_order"))


@query("""select a.o_orderkey as one, b.o_orderkey as other from orders a join orders b on a.o_orderpriority = b.o_orderpriority and a.o_orderstatus = b.o_orderstatus and a.o_orderkey < b.o_orderkey
and abs(a.o_totalprice - b.o_totalprice) <= greatest(1024, 0.001 * greatest(a.o_totalprice, b.o_totalprice))""")
def q_band_pairs(spark, folder):
    """All pairs of a priority and status whose prices are within the tolerance; they are as many as the prices are dense."""
    return links.within_tolerance(Tables(spark, folder).orders, on=["o_orderpriority", "o_orderstatus"], key="o_orderkey", value="o_totalprice", least=1024, share=0.001).select("one", "other")


@query("""with recursive p as (select a.o_orderkey as one, b.o_orderkey as other, -abs(a.o_totalprice - b.o_totalprice) as score from orders a join orders b
on a.o_orderpriority = b.o_orderpriority and a.o_orderstatus = b.o_orderstatus and a.o_orderkey < b.o_orderkey and abs(a.o_totalprice - b.o_totalprice) <= 1024),
r(one, other, score, taken) as (select one, other, score, false from p union all select one, other, score, taken from (
with live as (select one, other, score, row_number() over (order by score desc, one, other) as k from r where not taken),
best as (select id, min(k) as k from (select one as id, k from live union all select other, k from live) group by id),
won as (select l.* from live l join (select k from best group by k having count(*) = 2) using (k)),
ids as (select one as id from won union all select other from won)
select one, other, score, true as taken from won union all
select one, other, score, false from live where one not in (select id from ids) and other not in (select id from ids)))
select one, other, score from r where taken""")
def q_band_pairs_greedy(spark, folder):
    """Greedy one-to-one matches of all pairs within 1024 of a priority and status, closest first; an order is in one pair at most."""
    shared_folder(spark)
    return links.closest_matching(Tables(spark, folder).orders, on=["o_orderpriority", "o_orderstatus"], key="o_orderkey", value="o_totalprice", least=1024)


def _supply_edges(lines):
    return lines.select(F.col("l_suppkey").alias("a"), (F.lit(100000) + F.col("l_partkey") % 997).alias("b"))


@query("""with recursive s as (select l_suppkey as a, 100000 + l_partkey % 997 as b from lineitem union select 100000 + l_partkey % 997, l_suppkey from lineitem),
c(node, component) using key (node) as (select distinct a, a from s union select s.b, min(c.component) from c join s on s.a = c.node join recurring.c as old on old.node = s.b where c.component < old.component group by s.b)
select node, component from c""")
def q_connected_components(spark, folder):
    """Suppliers and part groups that any line connects."""
    shared_folder(spark)
    return sequences.label_spread(_supply_edges(Tables(spark, folder).lineitem))


@query("""with m as (select doc_id from labels where toxic = 1), e as (select doc_id from documents where contains(lower(text), 'license'))
select coalesce(m.doc_id, e.doc_id) as doc_id, case when m.doc_id is null then 'edition' when e.doc_id is null then 'machine' else 'both' end as evidence from m full join e on m.doc_id = e.doc_id""")
def q_set_union_evidence(spark, folder):
    t = Tables(spark, folder)
    m = t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("m"))
    e = t.documents.where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", F.lit(True).alias("e"))
    kind = F.when(F.col("m").isNull(), "edition").when(F.col("e").isNull(), "machine").otherwise("both")
    return m.join(e, "doc_id", "full_outer").select("doc_id", kind.alias("evidence"))


@query("""select doc_id, 'documents' as side from (select doc_id from documents except select doc_id from labels) union all
select doc_id, 'labels' from (select doc_id from labels except select doc_id from documents)""")
def q_sym_diff(spark, folder):
    t = Tables(spark, folder)
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.exceptAll(b.distinct()).distinct().withColumn("side", F.lit("documents")).unionAll(b.exceptAll(a.distinct()).distinct().withColumn("side", F.lit("labels")))


@query("select doc_id from documents where n_chars > 1000 intersect select doc_id from labels where quality = 1")
def q_intersect(spark, folder):
    t = Tables(spark, folder)
    return t.documents.where("n_chars > 1000").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("""select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as level, count(*) as n, cast(sum(l_quantity) as bigint) as quantity
from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def q_grouping_sets_report(spark, folder):
    li = Tables(spark, folder).lineitem
    return li.groupingSets([("l_returnflag", "l_linestatus"), ("l_returnflag",), ("l_linestatus",), ()], "l_returnflag", "l_linestatus").agg(
        F.grouping_id("l_returnflag", "l_linestatus").cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity")
    )


@query("select o_orderpriority, o_orderstatus, count(*) as n from orders group by rollup (o_orderpriority, o_orderstatus)")
def q_rollup_patterns(spark, folder):
    return Tables(spark, folder).orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)")
def q_cube_report(spark, folder):
    return Tables(spark, folder).customer.cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderpriority, count_if(o_orderstatus = 'F') as f, count_if(o_orderstatus = 'O') as o, count_if(o_orderstatus = 'P') as p from orders group by 1""")
def q_pivot_status_by_set(spark, folder):
    made = Tables(spark, folder).orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return made.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("""select case when n_chars = 0 then '0' when n_chars between 1 and 500 then '1-500' when n_chars between 501 and 2000 then '501-2000' when n_chars between 2001 and 8000 then '2001-8000' else '8001+' end as bin, count(*) as n from documents group by 1""")
def q_closed_histogram(spark, folder):
    bins = evaluation.closed_bins(F.col("n_chars"), [(0, 0), (1, 500), (501, 2000), (2001, 8000), (8001, None)])
    return Tables(spark, folder).documents.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(0 + least(greatest(floor((n_chars - 0) / 250.0), 0), 39) * 250 as bigint) as lo, count(*) as n from documents group by 1")
def q_length_bins(spark, folder):
    return Tables(spark, folder).documents.groupBy(evaluation.fixed_bins(F.col("n_chars"), 0, 10000, 250).cast("long").alias("lo")).agg(F.count(F.lit(1)).alias("n"))


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_doc from documents group by text having count(*) > 1 order by n desc, first_doc limit 15")
def q_topk_duplicates(spark, folder):
    d = Tables(spark, folder).documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return d.where("n > 1").orderBy(F.col("n").desc(), "first_doc").limit(15)


@query("""select l_orderkey, count(*) as n_lines, round(avg(l_quantity), 6) as mean_height, round(median(l_quantity), 6) as median_height,
round(stddev_pop(l_quantity) / avg(l_quantity), 6) as height_cv, count_if(l_quantity < 10) as n_short from lineitem group by 1""")
def q_seg_stats(spark, folder):
    q = F.col("l_quantity")
    return Tables(spark, folder).lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.avg(q), 6).alias("mean_height"), F.round(F.percentile(q, F.lit(0.5)), 6).alias("median_height"), F.round(F.stddev_pop(q) / F.avg(q), 6).alias("height_cv"), F.count_if(q < 10).alias("n_short")
    )


@query("""with b as (select lang, quantile_cont(n_chars, 0.025) as low, quantile_cont(n_chars, 0.975) as high from documents group by 1)
select doc_id, lang, case when n_chars < low then 'low' else 'high' end as outside from documents join b using (lang) where n_chars < low or n_chars > high""")
def q_quantile_band_outliers(spark, folder):
    d = Tables(spark, folder).documents.select("doc_id", "lang", "n_chars")
    band = evaluation.quantile_band(d, ["lang"], "n_chars")
    return d.join(band, "lang").where("n_chars < low or n_chars > high").select("doc_id", "lang", F.when(F.col("n_chars") < F.col("low"), "low").otherwise("high").alias("outside"))


@query("select p, quantile_disc(value, p) as value from events, (values (0.5), (0.95), (1.0)) t(p) group by p".replace("quantile_disc(value, p)", "case p when 0.5 then quantile_disc(value, 0.5) when 0.95 then quantile_disc(value, 0.95) else max(value) end").replace("select p,", "select cast(p as double) as p,"))
def q_nearest_rank_percentiles(spark, folder):
    return evaluation.nearest_rank(Tables(spark, folder).events, "value", [0.5, 0.95, 1.0])


@query("""select n_name, r_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders from region join nation on n_regionkey = r_regionkey
join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2""")
def q_star_rollup(spark, folder):
    t = Tables(spark, folder)
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("o"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.customer.join(per, "c_custkey", "left").join(named, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("o"), F.lit(0)).alias("orders"))


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price,
round(cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*), 6) as mean_discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def q_pricing_summary(spark, folder):
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    li = Tables(spark, folder).lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(dec("l_quantity").alias("sum_qty"), dec("l_extendedprice").alias("sum_price"), F.round(dec("l_discount") / F.count(F.lit(1)), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, o_custkey from orders where (o_custkey > 700 or (o_custkey = 700 and o_orderkey > 100)) order by o_custkey, o_orderkey limit 50""")
def q_keyset_page(spark, folder):
    after = (F.col("o_custkey") > 700) | ((F.col("o_custkey") == 700) & (F.col("o_orderkey") > 100))
    return Tables(spark, folder).orders.where(after).select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey").limit(50)


@query("""with p as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders), d as (select o_custkey, max(o_totalprice) as top from p group by 1)
select kind, count(*) as n from (select case when p.o_totalprice = d.top and row_number() over (partition by p.o_custkey order by p.o_totalprice desc, p.o_orderkey) = 1 then 'kept' when p.o_totalprice = d.top then 'duplicate' else 'superseded' end as kind from p join d using (o_custkey)) group by 1""")
def q_latest_decisions(spark, folder):
    _, counts = versions.latest_decisions(Tables(spark, folder).orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")
    return counts


@query("""select case when list_contains(ch, 'x') then 'nc' when len(ch) > 0 then 'open' else 'none' end as deposit, count(*) as n from (
select case when o_orderkey % 5 = 0 then [] when o_orderkey % 3 = 0 then ['a','x'] else ['a'] end as ch from orders) group by 1""")
def q_deposit_routing(spark, folder):
    ch = F.expr("case when o_orderkey % 5 = 0 then array() when o_orderkey % 3 = 0 then array('a','x') else array('a') end")
    kind = F.coalesce(catalog.deposit(F.col("ch"), F.when(F.size("ch") > 0, "open"), {"a": "open", "x": "nc"}), F.lit("none"))
    return Tables(spark, folder).orders.select(ch.alias("ch")).groupBy(kind.alias("deposit")).agg(F.count(F.lit(1)).alias("n"))


@query("""select p_brand, p_partkey, p_retailprice, rn from (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn <= 3""")
def q_topk_per_group(spark, folder):
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return Tables(spark, folder).part.select("p_brand", "p_partkey", "p_retailprice", rn.cast("long").alias("rn")).where("rn <= 3")


# --- sampling ----------------------------------------------------------------------------------------------------


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || doc_id), doc_id) as rn from documents) where rn <= 5")
def q_stratified_quota(spark, folder):
    return sampling.stratified(Tables(spark, folder).documents.select("doc_id", "lang"), ["lang"], "doc_id", 5, seed=42)


@query("""select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256('7:' || doc_id), doc_id) as rn from documents) order by rn, sha256('7:' || source), source limit 30""")
def q_round_robin_sample(spark, folder):
    return sampling.round_robin(Tables(spark, folder).documents.select("doc_id", "source"), "source", "doc_id", 30, seed=7)


@query("""with c as (select lang, count(*) as n from documents group by 1), e as (select lang, n, 97.0::double * n / sum(n) over () as x from c), b as (select *, floor(x) as q, row_number() over (order by x - floor(x) desc, lang) as rn from e)
select lang, n, cast(q + case when rn <= 97 - sum(q) over () then 1 else 0 end as bigint) as quota from b""")
def q_largest_remainder(spark, folder):
    cells = Tables(spark, folder).documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.proportional_quotas(cells, ["lang"], "n", 97)


@query("""with g as (select source, count(*) as n from documents group by 1), w as (select source, n, sum(n) over (order by sha256('3:' || source), source) as upto, sum(n) over () as total from g)
select source, case when upto <= total * 0.2 then 'validation' else 'training' end as split, n from w""")
def q_split_units(spark, folder):
    rows = sampling.whole_groups(Tables(spark, folder).documents.select("doc_id", "source"), "source", "doc_id", 0.2, seed=3)
    return rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when row_number() over (partition by lang order by sha256('5:' || doc_id), doc_id) % 2 = 1 then 'a' else 'b' end as half from documents")
def q_split_halves(spark, folder):
    return sampling.halves(Tables(spark, folder).documents.select("doc_id", "lang"), ["lang"], "doc_id", seed=5).select("doc_id", "half")
