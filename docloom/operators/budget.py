"""Monthly budgets of users and of the site: how they stand, who may go on, alerts, and reservations in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ALERT_PERCENT, JOB_LIMIT, SITE_LIMIT, USER_LIMIT

MONEY = "decimal(18,6)"
SITE = 0
WHOLE = -1  # the site's entry in a ledger, where a user may be 0
FIRST = -(2**60)  # before every hour and instant


def limit_of(userid: Column, own: Column, user_limit: int = USER_LIMIT, site_limit: int = SITE_LIMIT) -> Column:
    """A row's own limit, else the default of the site or of users; 0 is none."""
    return F.coalesce(own.cast(MONEY), F.when(userid == SITE, F.lit(site_limit)).otherwise(F.lit(user_limit)).cast(MONEY))


def standing(budgets: DataFrame, user_limit: int = USER_LIMIT, site_limit: int = SITE_LIMIT, alert: int = ALERT_PERCENT) -> DataFrame:
    """``userid, period, limit, used, percent, state, remaining, at_alert`` of every row.

    ``percent`` of the limit that is spent or reserved, 0 without a limit; ``state`` is ok, alert
    or exceeded; ``remaining`` is -1 without a limit, else at least 0. The site comes first, then the most used.
    """
    limit = limit_of(F.col("userid"), F.col("limitusd"), user_limit, site_limit)
    rows = budgets.select("userid", "period", limit.alias("limit"), (F.col("spentusd") + F.col("reservedusd")).cast(MONEY).alias("used"))
    some = F.col("limit") > 0
    percent = F.when(some, F.col("used").cast("double") / F.col("limit").cast("double") * 100).otherwise(0.0)
    state = F.when(~some, "ok").when(F.col("used") >= F.col("limit"), "exceeded").when((F.lit(alert) > 0) & (F.col("percent") >= alert), "alert").otherwise("ok")
    left = F.when(some, F.greatest(F.lit(0).cast(MONEY), (F.col("limit") - F.col("used")).cast(MONEY))).otherwise(F.lit(-1).cast(MONEY))
    out = rows.withColumn("percent", percent).withColumns({"state": state, "remaining": left, "at_alert": some & (F.lit(alert) > 0) & (F.col("percent") >= alert)})
    return out.orderBy("period", F.col("userid") != SITE, F.desc("percent"), "userid")


def remaining(users: DataFrame, budgets: DataFrame, user_limit: int = USER_LIMIT, site_limit: int = SITE_LIMIT) -> DataFrame:
    """``userid, remaining`` for ``users(userid)`` in one month's ``budgets``; a user without a row has used nothing."""
    own = standing(budgets, user_limit, site_limit).select("userid", F.col("remaining").alias("own"))
    limit = limit_of(F.col("userid"), F.lit(None), user_limit, site_limit)
    none = F.when(limit > 0, limit).otherwise(F.lit(-1).cast(MONEY))
    return users.select("userid").join(own, "userid", "left").select("userid", F.coalesce("own", none).alias("remaining"))


def gates(jobs: DataFrame, left: DataFrame, site_left: Column, job_limit: int = JOB_LIMIT) -> DataFrame:
    """``jobid, within, resumable``: whether a job's estimate fits the job's, its user's and the site's limits, and whether a paused job has room.

    ``left``: ``userid, remaining``. A limit of 0 and a remainder below 0 don't bind.
    """
    rows = jobs.join(left, "userid")
    cost, spent, user = F.col("estimatedcost"), F.col("actualcost"), F.col("remaining")
    fits = lambda room: (room < 0) | (cost <= room)
    within = ((F.lit(job_limit) <= 0) | (cost <= job_limit)) & fits(user) & fits(site_left)
    room = ((F.lit(job_limit) <= 0) | (spent < job_limit)) & (user != 0) & (site_left != 0)
    return rows.select(F.col("id").alias("jobid"), within.alias("within"), room.alias("resumable"))


def refused_by_job(spent: Column, estimate: Column, limit: Column) -> Column:
    return (limit > 0) & (spent + estimate > limit)


def running(charges: DataFrame, keys: list[str], order: list[str], amount: str, bucket: Column, name: str = "running") -> DataFrame:
    """``charges`` with the sum of ``amount`` up to each row among equal ``keys``.

    ``bucket`` must not fall along ``order``. Sums per bucket, combined before the shuffle, give
    where each bucket starts, so a key with most of the rows is ordered bucket by bucket, in many tasks.
    """
    rows = charges.withColumn("bucket_", bucket)
    starts = rows.groupBy(*keys, "bucket_").agg(F.sum(amount).alias("sum_"))
    before = F.sum("sum_").over(Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*keys, "bucket_", F.coalesce(before, F.lit(0)).alias("start_"))
    within = F.sum(amount).over(Window.partitionBy(*keys, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("within_", within).join(starts, [*keys, "bucket_"])
    return out.select(*charges.columns, (F.col("start_") + F.col("within_")).alias(name))


def alert_edges(charges: DataFrame, limit: Column, percent: int = ALERT_PERCENT) -> DataFrame:
    """``userid, period, id, spent, edge``: the charges at which spending (without reservations) reaches the alert share (1) or falls back below it (-1).

    ``charges(userid, period, id, timecreated, amount)``: refunds are negative.
    """
    keys, order = ["userid", "period"], ["timecreated", "id"]
    day = F.floor(F.col("timecreated") / 86400)
    rows = running(charges.withColumn("limit_", limit), keys, order, "amount", day, "spent")
    reached = (F.col("limit_") > 0) & (F.lit(percent) > 0) & (F.col("spent") * 100 >= F.col("limit_") * percent)
    before = (F.col("limit_") > 0) & (F.lit(percent) > 0) & ((F.col("spent") - F.col("amount")) * 100 >= F.col("limit_") * percent)
    edge = F.when(reached & ~before, 1).when(~reached & before, -1)
    return rows.select("userid", "period", "id", F.col("spent").cast(MONEY).alias("spent"), edge.alias("edge")).where("edge is not null")


def admitted_batches(calls: DataFrame, limit: Column) -> DataFrame:
    """``batch, calls, estimate, admitted``: all calls of a batch are reserved or none; ``calls(batch, estimate)``, estimates not negative.

    With such estimates the largest running sum is the sum, so no order is needed.
    """
    out = calls.groupBy("batch").agg(F.count(F.lit(1)).alias("calls"), F.sum("estimate").cast(MONEY).alias("estimate"))
    return out.withColumn("admitted", (limit <= 0) | (F.col("estimate") <= limit))


def job_actual_costs(calls: DataFrame) -> DataFrame:
    """``jobid, actualcost``: what a job has paid so far, never below 0."""
    return calls.where("jobid is not null").groupBy("jobid").agg(F.greatest(F.lit(0).cast(MONEY), F.sum("cost").cast(MONEY)).alias("actualcost"))


def transitions(jobs: DataFrame, event: Column) -> DataFrame:
    """``jobid, status, after, allowed``: a budget stop pauses a running job, resuming queues a paused one at the stage it had."""
    runs = F.col("status").isin("queued", "ingesting", "generating")
    after = F.when((event == "stop") & runs, "paused").when((event == "resume") & (F.col("status") == "paused"), "queued")
    return jobs.select(F.col("id").alias("jobid"), "status", F.coalesce(after, F.col("status")).alias("after"), after.isNotNull().alias("allowed"))


LEDGER = "period string, userid long, call long, kind string, outcome string, spent long, reserved long"


class Ledger:
    """Spent and reserved micro-dollars of one month's users and site, and the open reservations."""

    def __init__(self, site_limit: int):
        self.site_limit, self.rows, self.open = site_limit, {}, {}

    def row(self, userid: int | None) -> list[int]:
        return self.rows.setdefault(WHOLE if userid is None else userid, [0, 0])

    def carry(self, userid: int, call: int, kind: str, amount: int) -> None:
        """What was spent or is held before the events begin."""
        for row in (self.row(userid), self.row(None)):
            row[kind == "held"] += amount
        if kind == "held":
            self.open[call] = amount

    def apply(self, userid: int, call: int, kind: str, amount: int, limit: int) -> tuple[str, int, int]:
        user, site = self.row(userid), self.row(None)
        if kind == "reserve":
            if limit > 0 and sum(user) + amount > limit:
                return ("refused by user", *user)
            if self.site_limit > 0 and sum(site) + amount > self.site_limit:
                return ("refused by site", *user)
            self.open[call] = amount
            user[1] += amount
            site[1] += amount
            return ("reserved", *user)
        held = self.open.pop(call, None)
        if held is None:
            return ("nothing held", *user)
        for row in (user, site):
            row[1] = max(0, row[1] - held)
            row[0] += amount if kind == "settle" else 0
        return ("settled" if kind == "settle" else "released", *user)


def _folds(rows: DataFrame, site_limit: int, carried: bool) -> DataFrame:
    """Each ``(period, fold)`` in order: the outcomes (``LEDGER``), or, if ``carried``, what its only user has spent and holds at its end, as events before all others."""
    keyed = rows.select("period", "fold", "at", "call", "kind", "userid", "amount", "limit")
    keyed = keyed.repartition("period", "fold").sortWithinPartitions("period", "fold", "at", "call", "kind")
    columns = ["period", "userid", "call", "kind", "outcome", "spent", "reserved"]
    states = ["period", "userid", "call", "kind", "amount", "limit", "at"]

    def ends(period: str, userid: int, ledger: Ledger) -> list[tuple]:
        held = [(period, userid, call, "held", amount, 0, FIRST) for call, amount in ledger.open.items()]
        return [(period, userid, -1, "spent", ledger.row(userid)[0], 0, FIRST), *held]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ledger = None, Ledger(site_limit)
        for batch in batches:
            out = []
            for period, f, _, call, kind, userid, amount, limit in batch.itertuples(index=False):
                if key != (period, f):
                    if carried and key:
                        out += ends(*key, ledger)
                    key, ledger = (period, f), Ledger(site_limit)
                if kind in ("spent", "held"):
                    ledger.carry(userid, call, kind, amount)
                    continue
                outcome = ledger.apply(userid, call, kind, amount, limit)
                if not carried:
                    out.append((period, userid, call, kind, *outcome))
            yield pd.DataFrame(out, columns=states if carried else columns)
        if carried and key:
            yield pd.DataFrame(ends(*key, ledger), columns=states)

    return keyed.mapInPandas(fold, "period string, userid long, call long, kind string, amount long, limit long, at long" if carried else LEDGER)


def reservations(events: DataFrame, site_limit: int = SITE_LIMIT * 1_000_000) -> DataFrame:
    """The outcome of each event in order: ``period, userid, call, kind, outcome, spent, reserved`` (the user's after it).

    ``events(period, userid, call, kind, amount, limit, at)``: ``reserve`` holds ``amount`` if
    the user's and the site's limits allow it, ``settle`` pays ``amount`` and frees what the
    call held, ``release`` only frees it. Amounts are micro-dollars; order is by ``at``, ``call``, kind.

    Refused calls use nothing up, so the outcome is a fold in order. Until the hour in which all
    that the month has asked for so far passes the site's limit, the site refuses nothing and each
    user is folded alone. The hours from there on are contested: one fold of the month, which begins with
    what its users have spent and hold by then. Rows stream through it and its state is one entry per user and
    open call, but the order itself is the one task it needs. (What a contested month carries over is
    folded a second time, as no table is written.)
    """
    hour = F.coalesce(F.floor(F.col("at") / 3600), F.lit(FIRST))
    asked = F.greatest(F.when(F.col("kind").isin("reserve", "settle"), F.col("amount")), F.lit(0))
    hours = events.groupBy("period", hour.alias("hour_")).agg(F.sum(asked).alias("asked_"))
    most = Window.partitionBy("period")
    hours = hours.withColumn("most_", F.sum("asked_").over(most.orderBy("hour_"))).withColumn("month_", F.sum("asked_").over(most))
    bound = F.lit(site_limit)
    limits = hours.select("period", "hour_", ((bound <= 0) | (F.col("most_") <= bound)).alias("free_"), ((bound > 0) & (F.col("month_") > bound)).alias("later_"))
    rows = events.withColumn("hour_", hour).join(limits, ["period", "hour_"])
    free = rows.where("free_").withColumn("fold", F.col("userid"))
    if site_limit <= 0:
        return _folds(free, site_limit, False)
    carried = _folds(free.where("later_"), site_limit, True)
    contested = rows.where("not free_").select(carried.columns).union(carried).withColumn("fold", F.lit(-1).cast("long"))
    return _folds(free.select(contested.columns).union(contested), site_limit, False)
