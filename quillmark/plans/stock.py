"""Queries over inventories, files, volumes, and two readings of the same lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import inventory
from quillmark.plans.registry import Tables, query


def _pages(t):
    k = F.col("l_orderkey")
    return t.lineitem.select(k.alias("page_id"), F.col("l_suppkey").alias("work_id"), F.when(k % 9 != 0, "u").alias("image_url"), F.when(k % 3 != 0, "s").alias("sha256"), (F.col("l_linenumber") * 100).alias("n_bytes"), (F.col("l_quantity") * 100).cast("int").alias("width"), F.when(k % 5 != 0, 1000).alias("height"))


def _works(t):
    return t.supplier.select(F.col("s_suppkey").alias("work_id"), F.concat(F.lit("set"), (F.col("s_suppkey") % 4).cast("string")).alias("set_name"))


@query("""select page_id, work_id from (select l_orderkey as page_id, l_suppkey as work_id from lineitem where l_orderkey % 9 <> 0 and l_orderkey % 3 = 0) where work_id in (select s_suppkey from supplier where s_suppkey % 4 = 1)""")
def q_fetch_targets(spark, folder):
    """Pages of a set that have an address and are not fetched yet."""
    t = Tables(spark, folder)
    return inventory.fetch_targets(_pages(t), _works(t), set_name="set1").select("page_id", "work_id")


@query("""with p as (select 'set' || (s_suppkey % 4) as set_name, l_orderkey as k, l_linenumber * 100 as b from lineitem join supplier on s_suppkey = l_suppkey)
select set_name, count_if(k % 9 <> 0) as targets, count_if(k % 3 <> 0) as fetched, cast(coalesce(sum(b) filter (k % 3 <> 0), 0) as bigint) as bytes, round(coalesce(sum(b) filter (k % 3 <> 0), 0) / count_if(k % 3 <> 0), 6) as mean_bytes from p group by rollup (set_name)""")
def q_image_stats(spark, folder):
    t = Tables(spark, folder)
    return inventory.image_stats(_pages(t), _works(t)).withColumn("mean_bytes", F.round("mean_bytes", 6))


@query("""select case when m < 1 then '0-1' when m < 3 then '1-3' when m < 5 then '3-5' when m < 8 then '5-8' when m < 12 then '8-12' else '>= 12' end as size, count(*) as n from (select cast(l_quantity * 100 as int) * 1000 / 1e6 as m from lineitem where l_orderkey % 3 <> 0 and l_orderkey % 5 <> 0) group by 1""")
def q_size_histogram(spark, folder):
    return inventory.size_histogram(_pages(Tables(spark, folder)))


@query("""select case when o_orderkey % 4 = 0 then 'unfetched' when o_orderkey % 7 = 0 then 'missing' when o_orderkey % 5 = 0 then 'size' when o_orderkey % 11 = 0 then 'checksum' else 'ok' end as state, count(*) as n from orders group by 1""")
def q_verified_files(spark, folder):
    """Pages against the files that are there."""
    k = F.col("o_orderkey")
    o = Tables(spark, folder).orders
    pages = o.select(k.alias("page_id"), k.cast("string").alias("path"), F.lit(10).alias("n_bytes"), F.when(k % 4 != 0, "d").alias("sha256"))
    files = o.where("o_orderkey % 7 <> 0").select(k.cast("string").alias("path"), F.when(k % 5 == 0, 9).otherwise(10).alias("bytes"), F.when(k % 11 == 0, "e").otherwise("d").alias("digest"))
    return inventory.verified_files(pages, files, deep=True).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) as n_pages, round(avg(l_linenumber), 6) as mean_lines, round(avg(l_discount), 6) as mean_coverage, round(avg(l_tax), 6) as mean_cv, round(avg(l_orderkey % 3), 6) as mean_overlaps, round(avg(l_orderkey % 4), 6) as mean_short,
round(100.0 * count_if(l_orderkey % 3 > 0) / count(*), 6) as pct_with_overlap, round(100.0 * count_if(l_orderkey % 4 > 0) / count(*), 6) as pct_with_short from lineitem""")
def q_segment_summary(spark, folder):
    k = F.col("l_orderkey")
    stats = Tables(spark, folder).lineitem.select(F.col("l_linenumber").alias("n_lines"), F.col("l_discount").alias("region_coverage"), F.col("l_tax").alias("line_height_cv"), (k % 3).alias("n_overlaps"), (k % 4).alias("n_short_lines"))
    made = inventory.segment_summary(stats)
    return made.select("n_pages", *(F.round(c, 6).alias(c) for c in made.columns[1:]))


@query("""select l_returnflag as class, count(*) as total, count(distinct l_orderkey) as pages_with, round(avg(l_discount), 6) as mean_confidence, round(count(*) / (select count(*) from orders), 6) as per_page from lineitem group by 1""")
def q_zone_report(spark, folder):
    t = Tables(spark, folder)
    zones = t.lineitem.select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("class"), F.col("l_discount").alias("confidence"))
    made = inventory.zone_report(zones, t.orders)
    return made.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "per_page")})


@query("""select bucket, count(*) as n from (select case when b = '' and a <> '' then 'ours_only' when a = '' and b <> '' then 'theirs_only' when a = '' then 'neither' when 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) >= 0.9 then 'both_same' else 'both_different' end as bucket from (
select case when o_orderkey % 4 = 0 then '' else o_orderpriority end as a, case when o_orderkey % 5 = 0 then '' when o_orderkey % 3 = 0 then o_orderpriority else o_orderstatus || o_orderpriority || 'xyz' end as b from orders)) group by 1""")
def q_reading_buckets(spark, folder):
    """Lines by what two readings made of them."""
    o = Tables(spark, folder).orders
    a = F.expr("case when o_orderkey % 4 = 0 then '' else o_orderpriority end")
    b = F.expr("case when o_orderkey % 5 = 0 then '' when o_orderkey % 3 = 0 then o_orderpriority else concat(o_orderstatus, o_orderpriority, 'xyz') end")
    return inventory.buckets(o, a, b).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select p_name as m, p_type as a, p_brand as b from part), s as (select 1 - levenshtein(m, a)::double / greatest(length(m), length(a)) as sa, 1 - levenshtein(m, b)::double / greatest(length(m), length(b)) as sb from x)
select count_if(abs(sa - sb) >= 1e-9 and sa > sb) as ours, count_if(abs(sa - sb) >= 1e-9 and sa < sb) as theirs, count_if(abs(sa - sb) < 1e-9) as tie from s""")
def q_witness_counts(spark, folder):
    return inventory.witness_counts(Tables(spark, folder).part, F.col("p_name"), F.col("p_type"), F.col("p_brand"))


@query("""with x as (select case when p_partkey % 6 = 0 then '' else p_type end as p, case when p_partkey % 4 = 0 then ' ' when p_partkey % 5 = 0 then p_type else p_type || p_brand end as c from part),
y as (select case when (trim(p) = '') <> (trim(c) = '') then 1.0::double when trim(p) = '' then 0.0 else levenshtein(c, p)::double / length(c) end as cer, (trim(p) = '') <> (trim(c) = '') as one from x)
select count(*) as sampled, count_if(cer > 0.1 or one) as flagged, count_if(one) as empty_disagreements, round(avg(cer), 6) as mean_cer from y""")
def q_extraction_quality(spark, folder):
    p = Tables(spark, folder).part.select(F.expr("case when p_partkey % 6 = 0 then '' else p_type end").alias("p"), F.expr("case when p_partkey % 4 = 0 then ' ' when p_partkey % 5 = 0 then p_type else concat(p_type, p_brand) end").alias("c"))
    return inventory.extraction_quality(p, "p", "c").withColumn("mean_cer", F.round("mean_cer", 6))


@query("""select action, count(*) as n from (select case when k % 7 = 6 then 'unjudged' when k % 7 = 5 then 'unreadable' when k % 4 <> 0 and k % 7 = 4 then 'wrong without a text' when k % 4 <> 0 and k % 7 = 3 then 'boundary without a text' when k % 13 = 0 then 'no row' when k % 11 = 0 then 'several rows' when k % 4 = 0 then 'correct' when k % 5 = 0 then 'text has changed' else 'confirm' end as action from (select o_orderkey as k from orders)) group by 1""")
def q_verified_plan(spark, folder):
    """What a judge's verdicts would do to the rows."""
    k = F.col("o_orderkey")
    o = Tables(spark, folder).orders
    said = F.expr("case o_orderkey % 7 when 6 then '' when 5 then 'unreadable' when 4 then 'wrong' when 3 then 'boundary' else 'Correct' end")
    verdicts = o.select(k.alias("ref"), said.alias("verdict"), F.lit("as  shown").alias("shown"))
    rows = o.where("o_orderkey % 13 <> 0").select(k.alias("ref"), F.when(k % 5 == 0, "changed").otherwise("as shown").alias("text"), F.explode(F.when(k % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return inventory.verified_plan(verdicts, rows, o.where("o_orderkey % 4 = 0").select(k.alias("ref"), F.lit("new").alias("corrected"))).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""with v as (select p_partkey % 8 as series, p_size as volume, case when count(*) over (partition by p_partkey % 8, p_size) > 1 then p_brand end as edition, 1900 + p_partkey % 100 as year from part),
p as (select series, volume, count(*) as n, bool_and(edition is null) as plain, bool_and(make_date(year + 70, 1, 1) <= date '2026-06-01') as free from v group by 1, 2), e as (select series, volume, edition, bool_or(make_date(year + 70, 1, 1) <= date '2026-06-01') as free from v where edition is not null group by 1, 2, 3),
s as (select p_partkey as id, p_partkey % 9 as series, p_size as volume, case when p_partkey % 3 = 0 then p_brand end as edition from part)
select id, case when p.n is null then false when p.n = 1 and p.plain then p.free else coalesce(e.free, false) end as free from s left join p using (series, volume) left join e on e.series = s.series and e.volume = s.volume and e.edition = s.edition""")
def q_free_copies(spark, folder):
    """Copies whose edition's text is free on a day."""
    part = Tables(spark, folder).part
    several = F.count(F.lit(1)).over(Window.partitionBy("series", "volume")) > 1
    volumes = part.select((F.col("p_partkey") % 8).alias("series"), F.col("p_size").alias("volume"), "p_brand", (1900 + F.col("p_partkey") % 100).cast("int").alias("year")).withColumn("edition", F.when(several, F.col("p_brand"))).drop("p_brand")
    sources = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 9).alias("series"), F.col("p_size").alias("volume"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("edition"))
    return inventory.free_copies(sources, volumes, F.lit("2026-06-01").cast("date"), term=F.lit(70)).select("id", "free")


@query("""select w, count(*) as n from (select case when (s and a > 0) or (not s and a > b) then 'ours' when b > 0 then 'stored' else 'none' end as w from (select l_linenumber % 3 as a, l_orderkey % 3 as b, l_suppkey % 2 = 0 as s from lineitem)) group by 1""")
def q_mint_winner(spark, folder):
    """Which minting of a piece stays."""
    li = Tables(spark, folder).lineitem
    return li.groupBy(inventory.winner(F.col("l_linenumber") % 3, F.col("l_orderkey") % 3, F.col("l_suppkey") % 2 == 0).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct lower(trim(p_brand)) as p_brand from part where p_size > 10")
def q_distinct_ids(spark, folder):
    part = Tables(spark, folder).part.select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("p_brand"), "p_size")
    return inventory.distinct_ids(part, "p_brand", where=F.col("p_size") > 10)
