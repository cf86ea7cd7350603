"""Queries of streams: each runs over the events there are and returns the result so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..sources.tables import table
from ..streaming import calls
from ..streaming import usage as S
from .registry import doubles, query


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema)
    micro = F.round(F.col("value") * 1000).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("ts", F.col("user_id").alias("userid"), micro.cast("decimal(12,6)").alias("cost"), (k * 10).alias("tokensin"), (k * 3).alias("tokensout"), (k * 5).alias("tokenscached"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))


@query(
    """select cast(epoch(date_trunc('hour', make_timestamp(timecreated * 1000000))) as bigint) as start, userid, cast(sum(cost) as double) as cost, cast(sum(tokensin) as bigint) as tokensin, cast(sum(tokensout) as bigint) as tokensout,
        cast(sum(tokenscached) as bigint) as tokenscached, count(*) as calls, count(*) filter (status = 'error') as errors from call_log group by 1, 2""",
    ("call_log",),
)
def stream_usage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.usage_by_window(log(spark, sf_dir)).withColumn("start", F.unix_timestamp("start"))
    return doubles(S.drained(rows, shared_folder(spark)))


@query(
    """with marked as (select user_id as userid, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
    numbered as (select *, sum(new) over (partition by userid order by ts rows unbounded preceding) as n from marked)
    select cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts) + interval 30 minutes)) as bigint) as "end", userid, count(*) as calls from numbered group by userid, n"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sessions(log(spark, sf_dir)).withColumns({"start": F.unix_timestamp("start"), "end": F.unix_timestamp("end")})
    return S.drained(rows, shared_folder(spark))


@query(
    """select event_id as call, 1 + event_id % 3 as attempt, user_id as userid, event_id % 40 as jobid, event_type as step, case when event_id % 4 = 0 then 'configured' else 'deepseek' end as connector, case when event_id % 4 = 0 then '' else 'flash' end as model,
        case when event_id % 4 = 0 then 0 else event_id % 900 end as tokensin, case when event_id % 4 = 0 then 0.0 else event_id % 700 / 1000.0 end::double as cost, case when event_type = 'error' then 'error' else 'success' end as status, nullif(event_id % 5 * 100, 0) as httpstatus
    from events where user_id % 7 <> 0"""
)
def stream_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts come twice where the event's number says so; every fourth was billed nothing, and some have no user."""
    k = F.col("event_id")
    billed = F.when(k % 4 != 0, F.struct(F.lit("deepseek").alias("connector"), F.lit("flash").alias("model"), (k % 900).alias("tokensin"), (k % 50).alias("tokensout"), F.lit(None).cast("long").alias("tokenscached"), ((k % 700) / 1000).cast("decimal(12,6)").alias("cost")))
    rows = S.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema).withColumn("again", F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))))
    attempts = rows.select(k.alias("call"), (1 + k % 3).alias("attempt"), "ts", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("userid"), (k % 40).alias("jobid"), F.col("event_type").alias("step"), F.lit("configured").alias("connector"), billed.alias("billed"), F.lit(5).alias("durationms"), (F.col("event_type") == "error").alias("error"), (k % 5 * 100).alias("httpstatus"))
    log = calls.append(attempts, shared_folder(spark))
    return doubles(log.select("call", "attempt", "userid", "jobid", "step", "connector", "model", "tokensin", "cost", "status", "httpstatus"))
