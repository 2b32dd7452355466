"""Queries of the stream operators, in their batch form, which is their meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.plans.registry import Tables, query
from quillmark.streaming import operators as stream


def _events(spark, folder):
    return Tables(spark, folder).events.withColumn("ts", F.col("ts").cast("timestamp"))


_TOTAL = "cast(sum(cast(value as decimal(18,2))) as double) as total"


@query(f"select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type, count(*) as n, {_TOTAL} from events group by 1, 2")
def q_stream_tumbling(spark, folder):
    made = stream.tumbling(_events(spark, folder), "ts", "1 hour", ["event_type"])
    return made.withColumn("start", F.unix_micros("start"))


@query(f"""with w as (select ts, value, time_bucket(interval '10 minutes', ts) - to_minutes(10 * k) as start from events, range(0, 3) r(k))
select epoch_us(start) as start, count(*) as n, {_TOTAL} from w where ts < start + interval '30 minutes' group by 1""")
def q_stream_sliding(spark, folder):
    return stream.sliding(_events(spark, folder), "ts", "30 minutes", "10 minutes").withColumn("start", F.unix_micros("start"))


@query("""with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts) as g from m)
select user_id, epoch_us(min(ts)) as start, count(*) as n from s group by user_id, g""")
def q_stream_session(spark, folder):
    made = stream.sessions(_events(spark, folder), "ts", "2 hours", ["user_id"])
    return made.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("select count(*) as n from (select distinct user_id, event_type, cast(ts as date) from events)")
def q_stream_dedup(spark, folder):
    e = _events(spark, folder).withColumn("day", F.to_date("ts"))
    return stream.once(e, ["user_id", "event_type", "day"], "ts", "1 day").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select user_id, list(struct_pack(level := 0.0::double, at := epoch_us(ts) / 1e6, n := 0::bigint) order by ts) as l from events group by 1),
r as (select user_id, len(l) as n, list_reduce(list_prepend(struct_pack(level := 3.0::double, at := l[1].at, n := 0::bigint), l), lambda s, x: struct_pack(
  level := least(3.0, s.level + (x.at - s.at) * (1.0::double / 3600)) - case when least(3.0, s.level + (x.at - s.at) * (1.0::double / 3600)) >= 1 then 1 else 0 end, at := x.at,
  n := s.n + case when least(3.0, s.level + (x.at - s.at) * (1.0::double / 3600)) >= 1 then 1 else 0 end)) as f from e)
select user_id, f.n as allowed, n from r""")
def q_token_bucket(spark, folder):
    """Events allowed by a bucket a user: one token an hour, three at most."""
    made = stream.token_bucket_batch(_events(spark, folder), "user_id", "ts", rate=1 / 3600, burst=3.0)
    return made.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("n"))
