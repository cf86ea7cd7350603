"""Reports over the append-only call log: sums by job, user, model and month.

A call log has ``userid, jobid, step, connector, model, tokensin, tokensout, tokenscached,
cost decimal(12,6), status, timecreated`` (epoch seconds). Every report is one aggregate
that combines before its shuffle; sums of no rows are 0.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REPORT_JOBS, REPORT_MONTHS
from ..functions.text import shorten

MONEY = "decimal(18,6)"
PERIOD = re.compile(r"\d{4}-(0[1-9]|1[0-2])", re.ASCII)


def money(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast(MONEY)


def sums() -> list[Column]:
    """The columns of every report."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokensin", "tokensout", "tokenscached")]
    return [money(F.sum("cost")).alias("cost"), *tokens, F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("status") == "error", 1)).alias("errors")]


def valid_period(period: Column) -> Column:
    """A month as ``YYYY-MM``, or '' for all time."""
    return F.coalesce(period.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z") | (period == ""), F.lit(False))


def period_start(period: Column) -> Column:
    """The first second of a month (UTC), null if it is not one."""
    return F.unix_timestamp(F.when(period.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z"), F.to_timestamp(F.concat(period, F.lit("-01")), "yyyy-MM-dd")))


def period_end(period: Column) -> Column:
    """The first second after a month."""
    start = F.to_date(F.timestamp_seconds(period_start(period)))
    return F.unix_timestamp(F.add_months(start, 1).cast("timestamp"))


def period_of(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def in_period(log: DataFrame, period: str = "") -> DataFrame:
    """The calls of a month; all for ''. The bounds are constants, so they reach the scan's statistics."""
    if period == "":
        return log
    if not PERIOD.fullmatch(period):
        raise ValueError(f"not a month: {period!r}")
    year, month = map(int, period.split("-"))
    first = datetime(year, month, 1, tzinfo=UTC)
    after = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=UTC)
    return log.where((F.col("timecreated") >= int(first.timestamp())) & (F.col("timecreated") < int(after.timestamp())))


def totals(log: DataFrame, period: str = "") -> DataFrame:
    """One row, also for an empty log."""
    return in_period(log, period).agg(*sums())


def by_job(log: DataFrame, jobs: DataFrame, period: str = "", most: int = REPORT_JOBS) -> DataFrame:
    """The ``most`` dearest pairs of job (0: none) and user, with the job's prompt, shortened, and status ('' if it is gone)."""
    top = in_period(log, period).groupBy(F.coalesce("jobid", F.lit(0)).alias("jobid"), "userid").agg(*sums())
    top = top.orderBy(F.desc("cost"), "jobid", "userid").limit(most)
    known = jobs.select(F.col("id").alias("jobid"), shorten(F.col("prompt"), 80).alias("prompt"), F.col("status").alias("jobstatus"))
    return top.join(known, "jobid", "left").fillna("", ["prompt", "jobstatus"])


def by_user(log: DataFrame, users: DataFrame, period: str = "") -> DataFrame:
    """Users by cost, with ``name`` from ``users(userid, name)`` ('' if gone)."""
    rows = in_period(log, period).groupBy("userid").agg(*sums())
    named = rows.join(users.select("userid", "name"), "userid", "left").fillna("", ["name"])
    return named.select("userid", "name", *[c for c in rows.columns if c != "userid"]).orderBy(F.desc("cost"), "userid")


def by_model(log: DataFrame, period: str = "") -> DataFrame:
    return in_period(log, period).groupBy("connector", "model").agg(*sums()).orderBy(F.desc("cost"), "connector", "model")


def periods(spark, now: int, months: int = REPORT_MONTHS) -> DataFrame:
    """The months up to that of ``now`` (epoch seconds), latest first: ``place, period``."""
    first = F.trunc(F.to_date(F.timestamp_seconds(F.lit(now))), "month")
    return spark.range(months).select(F.col("id").alias("place"), F.date_format(F.add_months(first, -F.col("id").cast("int")), "yyyy-MM").alias("period"))


def periods_of(log: DataFrame, months: int = REPORT_MONTHS) -> DataFrame:
    """The months up to that of the log's last call, latest first: ``place, period``. An empty log has none."""
    last = log.agg(F.trunc(F.to_date(F.timestamp_seconds(F.max("timecreated"))), "month").alias("last")).where("last is not null")
    rows = last.select("last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(months - 1).cast("long"))).alias("place"))
    return rows.select("place", F.date_format(F.add_months("last", -F.col("place").cast("int")), "yyyy-MM").alias("period"))


def by_month(log: DataFrame, now: int, months: int = REPORT_MONTHS) -> DataFrame:
    """The last ``months`` months, latest first; months without calls have zeros. One aggregate over the months' calls."""
    calendar = periods(log.sparkSession, now, months)
    end = datetime.fromtimestamp(now, UTC)
    first = end.year * 12 + end.month - months  # months since year 0
    from_second = int(datetime(first // 12, first % 12 + 1, 1, tzinfo=UTC).timestamp())
    got = log.where(F.col("timecreated") >= from_second).groupBy(period_of(F.col("timecreated")).alias("period")).agg(*sums())
    out = calendar.join(got, "period", "left")
    return out.select("place", "period", *[money(F.col(c)).alias(c) if c == "cost" else F.coalesce(c, F.lit(0)).alias(c) for c in ("cost", "tokensin", "tokensout", "tokenscached", "calls", "errors")]).orderBy("place")


def cube(log: DataFrame) -> DataFrame:
    """Extension: all reports by period, connector, model and status in one pass of grouping sets; '' stands for all."""
    named = log.withColumn("period", period_of(F.col("timecreated")))
    levels = ("period", "connector", "model")
    out = named.rollup(*levels).agg(*sums(), *[F.grouping(c).alias(f"all_{c}") for c in levels])
    return out.select(*[F.when(F.col(f"all_{c}") == 1, "").otherwise(F.col(c)).alias(c) for c in levels], "cost", "tokensin", "tokensout", "tokenscached", "calls", "errors")


# Steps of a job


def step_totals(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Sums over each job's steps, zeros for a job that has none."""
    names = ("cost", "tokensin", "tokensout", "tokenscached")
    got = steps.groupBy(F.col("jobid").alias("id")).agg(*[F.sum(c).alias(c) for c in names])
    return jobs.select("id").join(got, "id", "left").select(F.col("id").alias("jobid"), *[money(F.col(c)).alias(c) if c == "cost" else F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def calls_per_step(log: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    return (log.where(F.col("step").isin(*only)) if only else log).groupBy("step").agg(F.count(F.lit(1)).alias("calls"))


def time_spans(steps: DataFrame) -> DataFrame:
    """Seconds from the first start to the last change of each job's steps."""
    return steps.groupBy("jobid").agg((F.max("timemodified") - F.min("timecreated")).alias("seconds"))


def source_of(nodekey: Column) -> Column:
    """The source number in a digest node's key (``s12`` or ``s12w3``), null for other nodes."""
    number = F.regexp_extract(nodekey, r"^s([0-9]+)(?:w[0-9]+)?$", 1)
    return F.when(number != "", number.cast("long"))


def cost_by_source(sources: DataFrame, calls: DataFrame) -> DataFrame:
    """Nodes, tokens and cost of each source of ``sources(source)``; zeros where it has none."""
    got = calls.select(source_of(F.col("nodekey")).alias("source"), "tokensin", "tokensout", "tokenscached", "cost").where("source is not null")
    got = got.groupBy("source").agg(F.count(F.lit(1)).alias("nodes"), *[F.sum(c).alias(c) for c in ("tokensin", "tokensout", "tokenscached", "cost")])
    names = ("nodes", "tokensin", "tokensout", "tokenscached")
    return sources.select("source").distinct().join(got, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], money(F.col("cost")).alias("cost"))


def cost_drift(jobs: DataFrame, steps: DataFrame, tolerance: str = "0.000001") -> DataFrame:
    """Jobs whose actual cost differs from the sum of their steps by more than ``tolerance``."""
    both = step_totals(jobs, steps).select(F.col("jobid").alias("id"), F.col("cost").alias("stepcost")).join(jobs.select("id", "actualcost"), "id")
    drift = F.abs(F.col("actualcost") - F.col("stepcost"))
    return both.where(drift > F.lit(tolerance).cast(MONEY)).select(F.col("id").alias("jobid"), "actualcost", "stepcost", drift.cast(MONEY).alias("drift"))


def run_quality(steps: DataFrame) -> DataFrame:
    """Per job: content nodes, nodes for people, fixes by kind, repairs beyond the first call, the outline's sections, and the share of cached input (null without any)."""
    content = F.col("step").isin("sections", "activities", "questions")
    manual = F.col("status").isin("manual", "error")
    return steps.groupBy("jobid").agg(
        F.count(F.when(content, 1)).alias("nodes"),
        F.count(F.when(manual, 1)).alias("manual"),
        F.array_join(F.array_sort(F.collect_set(F.when(manual, F.col("nodekey")))), ",").alias("manual_nodes"),
        F.count(F.when(F.col("reason") == "cleaned", 1)).alias("cleaned"),
        F.count(F.when(F.col("reason") == "repaired", 1)).alias("repaired"),
        F.sum(F.col("attempts") - 1).cast("long").alias("repairs"),
        F.max(F.when(F.col("step") == "outline", F.json_array_length(F.get_json_object("output", "$.sections")))).cast("long").alias("sections"),
        F.sum("tokensin").alias("tokensin"), F.sum("tokensout").alias("tokensout"), F.sum("tokenscached").alias("tokenscached"),
        (F.sum("tokenscached") / F.nullif(F.sum("tokensin"), F.lit(0))).alias("cached_share"),
    )
