"""Queries of the call log's reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from ..sources.tables import relation, table
from .registry import doubles, query

#: Wednesday 15 August 2001, within the last month of the long log.
NOW = 997833600

SUMS = """cast(coalesce(sum(cost), 0) as double) as cost, cast(coalesce(sum(tokensin), 0) as bigint) as tokensin,
    cast(coalesce(sum(tokensout), 0) as bigint) as tokensout, cast(coalesce(sum(tokenscached), 0) as bigint) as tokenscached,
    count(*) as calls, count(*) filter (status = 'error') as errors"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("userid"), F.col("c_name").alias("name"))


USERS = "users as (select c_custkey as userid, c_name as name from customer where c_custkey % 10 <> 3)"


@query(f"select {SUMS} from call_log", ("call_log",))
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.totals(relation(spark, sf_dir, "call_log")))


@query(f"select {SUMS} from long_log where timecreated >= epoch(timestamp '1999-12-01') and timecreated < epoch(timestamp '2000-01-01')", ("long_log",))
def usage_totals_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.totals(relation(spark, sf_dir, "long_log"), "1999-12"))


@query(f"with {USERS} select userid, coalesce(name, '') as name, {SUMS} from call_log left join users using (userid) group by all", ("call_log",))
def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.by_user(relation(spark, sf_dir, "call_log"), users(spark, sf_dir)))


@query(
    f"""with top as (select coalesce(jobid, 0) as jobid, userid, {SUMS} from call_log group by all order by cost desc, 1, 2 limit 100)
    select top.*, coalesce(case when length(prompt) > 80 then regexp_replace(substr(prompt, 1, 77), ' [^ ]*$', '') || '...' else prompt end, '') as prompt, coalesce(job.status, '') as jobstatus
    from top left join job on job.id = jobid""",
    ("call_log", "job"),
)
def usage_by_job_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.by_job(relation(spark, sf_dir, "call_log"), relation(spark, sf_dir, "job")))


@query(f"select connector, model, {SUMS} from call_log group by all", ("call_log",))
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.by_model(relation(spark, sf_dir, "call_log")))


@query(
    f"""with months as (select i as place, strftime(date '2001-08-01' - to_months(cast(i as int)), '%Y-%m') as period from range(12) t(i)),
    got as (select strftime(make_timestamp(timecreated * 1000000), '%Y-%m') as period, {SUMS} from long_log group by 1)
    select place, period, coalesce(cost, 0) as cost, coalesce(tokensin, 0) as tokensin, coalesce(tokensout, 0) as tokensout, coalesce(tokenscached, 0) as tokenscached, coalesce(calls, 0) as calls, coalesce(errors, 0) as errors
    from months left join got using (period)""",
    ("long_log",),
)
def usage_by_month_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.by_month(relation(spark, sf_dir, "long_log"), NOW))


@query("select i as place, strftime(date_trunc('month', make_timestamp(last * 1000000)) - to_months(cast(i as int)), '%Y-%m') as period from (select max(timecreated) as last from long_log), range(12) t(i)", ("long_log",))
def usage_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.periods_of(relation(spark, sf_dir, "long_log"))


@query(
    """with names as (select o_orderkey, case when o_orderkey % 15 = 0 then '' else year(o_orderdate) || '-' || lpad(cast(o_orderkey % 15 as varchar), 2, '0') end as period from orders),
    valid as (select *, regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2])') as month from names)
    select o_orderkey, period, month or period = '' as valid, cast(case when month then epoch(cast(period || '-01' as timestamp)) end as bigint) as first,
        cast(case when month then epoch(cast(period || '-01' as timestamp) + interval 1 month) end as bigint) as after
    from valid"""
)
def usage_period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 15).cast("string"), 2, "0"))
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 15 == 0, "").otherwise(month).alias("period"))
    period = F.col("period")
    return names.select("o_orderkey", "period", usage.valid_period(period).alias("valid"), usage.period_start(period).alias("first"), usage.period_end(period).alias("after"))


@query(
    f"""with named as (select *, strftime(make_timestamp(timecreated * 1000000), '%Y-%m') as p from call_log)
    select case when grouping(p) = 1 then '' else p end as period, case when grouping(connector) = 1 then '' else connector end as connector,
        case when grouping(model) = 1 then '' else model end as model, {SUMS} from named group by rollup (p, connector, model)""",
    ("call_log",),
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.cube(relation(spark, sf_dir, "call_log")))


@query(
    """select job.id as jobid, cast(coalesce(sum(cost), 0) as double) as cost, cast(coalesce(sum(tokensin), 0) as bigint) as tokensin,
        cast(coalesce(sum(tokensout), 0) as bigint) as tokensout, cast(coalesce(sum(tokenscached), 0) as bigint) as tokenscached
    from job left join step on jobid = job.id group by 1""",
    ("job", "step"),
)
def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.step_totals(relation(spark, sf_dir, "job"), relation(spark, sf_dir, "step")))


@query("select step, count(*) as calls from call_log group by 1", ("call_log",))
def calls_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.calls_per_step(relation(spark, sf_dir, "call_log"))


@query("select step, count(*) as calls from step where step in ('digest', 'review') group by 1", ("step",))
def calls_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.calls_per_step(relation(spark, sf_dir, "step"), ("digest", "review"))


@query("select jobid, max(timemodified) - min(timecreated) as seconds from step group by 1", ("step",))
def job_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.time_spans(relation(spark, sf_dir, "step"))


@query(
    """with got as (select cast(nullif(regexp_extract(nodekey, '^s([0-9]+)(w[0-9]+)?$', 1), '') as bigint) as source, count(*) as nodes, sum(tokensin) as tokensin, sum(tokensout) as tokensout, sum(tokenscached) as tokenscached, sum(cost) as cost from step group by 1)
    select s_suppkey as source, coalesce(nodes, 0) as nodes, cast(coalesce(tokensin, 0) as bigint) as tokensin, cast(coalesce(tokensout, 0) as bigint) as tokensout, cast(coalesce(tokenscached, 0) as bigint) as tokenscached, cast(coalesce(cost, 0) as double) as cost
    from supplier left join got on source = s_suppkey""",
    ("step",),
)
def cost_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    return doubles(usage.cost_by_source(sources, relation(spark, sf_dir, "step")))


@query(
    """with per as (select job.id as jobid, actualcost, coalesce(sum(cost), 0) as stepcost from job left join step on jobid = job.id group by 1, 2)
    select jobid, cast(actualcost as double) as actualcost, cast(stepcost as double) as stepcost, cast(abs(actualcost - stepcost) as double) as drift from per where abs(actualcost - stepcost) > 0.000001""",
    ("job", "step"),
)
def cost_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(usage.cost_drift(relation(spark, sf_dir, "job"), relation(spark, sf_dir, "step")))


@query(
    """select jobid, count(*) filter (step in ('sections', 'activities', 'questions')) as nodes, count(*) filter (status in ('manual', 'error')) as manual,
        coalesce(string_agg(distinct nodekey, ',' order by nodekey) filter (status in ('manual', 'error')), '') as manual_nodes,
        count(*) filter (reason = 'cleaned') as cleaned, count(*) filter (reason = 'repaired') as repaired, cast(sum(attempts - 1) as bigint) as repairs,
        max(attempts + 2) filter (step = 'outline') as sections, cast(sum(tokensin) as bigint) as tokensin, cast(sum(tokensout) as bigint) as tokensout, cast(sum(tokenscached) as bigint) as tokenscached,
        sum(tokenscached)::double / nullif(sum(tokensin), 0)::double as cached_share
    from step group by 1""",
    ("step",),
)
def run_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline has as many sections as it had attempts, and two more."""
    steps = relation(spark, sf_dir, "step")
    outline = F.to_json(F.struct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("attempts").cast("long") + 1), lambda i: F.struct(i.alias("id"))).alias("sections")))
    return usage.run_quality(steps.withColumn("output", F.when(F.col("step") == "outline", outline).otherwise(F.col("output"))))
