"""Prices joined to calls, price books checked, and forecasts of what a job will cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, DIGEST_WINDOW, NODE_INPUT, OUTPUT, PRICES, PROMPT_OVERHEAD, REPAIR_MARGIN, REVIEW_INPUT_FACTOR
from ..functions import pricing
from ..functions.text import tokens

#: Connectors whose cache serves the prefix that the calls of a job share.
PREFIX_CACHE = ("deepseek", "anthropic")
ROUTES = {"digest": ("deepseek", "deepseek-flash"), "brief": ("deepseek", "deepseek-flash"), "outline": ("deepseek", "deepseek-v4-pro"), "sections": ("deepseek", "deepseek-flash"), "activities": ("deepseek", "deepseek-flash"), "questions": ("deepseek", "deepseek-v4-pro"), "review": ("gemini", "gemini-flash")}


def price_book(spark: SparkSession, prices: tuple = PRICES) -> DataFrame:
    names = ("miss", "hit", "output", "off_miss", "off_hit", "off_output")
    rows = [(c, m, *map(Decimal, p)) for c, m, *p in prices]
    return spark.createDataFrame(rows, "connector string, model string, " + ", ".join(f"{n} decimal(10,4)" for n in names))


def call_costs(calls: DataFrame, book: DataFrame, at: str = "timecreated") -> DataFrame:
    """``calls`` with ``price``: USD by the book, off-peak prices off-peak where it has them, 0 for unknown models.

    The price book is a setting of a few rows per connector; the planner broadcasts it by its size.
    """
    peak = pricing.is_peak(F.col(at))
    pick = lambda on, off: F.when(peak | F.col(off).isNull(), F.col(on)).otherwise(F.col(off))
    prices = {"input_miss": pick("miss", "off_miss"), "input_hit": pick("hit", "off_hit"), "output": pick("output", "off_output")}
    joined = calls.join(book, ["connector", "model"], "left")
    return joined.select(*[calls[c] for c in calls.columns if c not in ("connector", "model")], "connector", "model", pricing.cost(prices, F.col("tokensin"), F.col("tokensout"), F.col("tokenscached")).alias("price"), peak.alias("peak"))


def precall_estimates(requests: DataFrame, book: DataFrame) -> DataFrame:
    """The most that a call can cost: ``requests(id, connector, model, input, maxtokens, at)``; all input missed, output at its limit (or as the input), one provider always at its peak."""
    n = tokens(F.col("input"), CHARS_PER_TOKEN)
    monday = F.lit(345600 + 2 * 3600)  # a Monday, 02:00 UTC
    sized = requests.select("id", "connector", "model", n.alias("tokensin"), F.when(F.col("maxtokens") > 0, F.col("maxtokens")).otherwise(n).alias("tokensout"), F.lit(0).alias("tokenscached"), F.when(F.col("connector") == "deepseek", monday).otherwise(F.col("at")).alias("at"))
    return call_costs(sized, book, "at").select("id", "tokensin", "tokensout", F.col("price").alias("estimate"))


def valid_price_books(prices: DataFrame) -> DataFrame:
    """``connector, valid``: a book of ``prices(connector, model, input_miss, input_hit, output, cache_write)`` (text; off-peak prices as rows of their own) is valid if every price is a number and not negative; a cache price may be missing."""
    ok = lambda c: pricing.is_number(F.col(c)) & (F.col(c).try_cast("double") >= 0)
    good = ok("input_miss") & ok("input_hit") & ok("output") & (F.col("cache_write").isNull() | ok("cache_write"))
    return prices.groupBy("connector").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))


def valid_peak_windows(windows: DataFrame) -> DataFrame:
    """``connector, valid`` of ``windows(connector, weekday, first, after)`` (text): weekdays 1 to 7, hours 0 to 24."""
    day, first, after = (F.col(c).try_cast("double") for c in ("weekday", "first", "after"))
    number = pricing.is_number(F.col("weekday")) & pricing.is_number(F.col("first")) & pricing.is_number(F.col("after"))
    good = number & (F.floor(day) >= 1) & (F.floor(day) <= 7) & first.between(0, 24) & after.between(0, 24)
    return windows.groupBy("connector").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))


def source_sizes(sources: DataFrame) -> DataFrame:
    """``jobid, source, tokens`` of the sources that did not fail."""
    size = pricing.source_tokens(F.col("tokencount"), F.col("filesize"), F.col("mimetype"), F.col("filename"))
    return sources.where("status <> 'failed'").select("jobid", F.col("id").alias("source"), size.alias("tokens"))


def forecast_calls(jobs: DataFrame, sources: DataFrame, routes: dict[str, tuple[str, str]], window: int = DIGEST_WINDOW) -> DataFrame:
    """The calls that jobs will make, equal ones once: ``jobid, step, calls, miss, hit, out``.

    Each source is digested in windows. Calls for the nodes share a prefix, which the first
    call to a caching connector and model pays and later ones find cached.
    """
    sized = source_sizes(sources)
    windows = F.greatest(F.lit(1), F.ceil(F.col("tokens") / window)).cast("long")
    digests = sized.groupBy("jobid").agg(F.sum(windows).alias("windows"), F.sum("tokens").alias("total"), F.collect_list(F.struct(windows.alias("calls"), (F.least("tokens", F.lit(window)) + PROMPT_OVERHEAD).cast("long").alias("miss"))).alias("digest"))
    nodes = pricing.node_count(pricing.duration_minutes(F.col("brief"), F.col("prompt"))).cast("long")
    known = jobs.select(F.col("id").alias("jobid"), nodes.alias("nodes")).join(digests, "jobid", "left").fillna(0, ["windows", "total"])
    digested = F.col("windows") * OUTPUT["digest"]
    prefix = F.col("total") + PROMPT_OVERHEAD + OUTPUT["brief"] + OUTPUT["outline"]
    call = lambda step, calls, miss, hit, out: F.struct(F.lit(step).alias("step"), calls.cast("long").alias("calls"), miss.cast("long").alias("miss"), hit.cast("long").alias("hit"), F.lit(out).cast("long").alias("out"))
    zero, one = F.lit(0), F.lit(1)
    rows = [call("brief", one, digested + PROMPT_OVERHEAD, zero, OUTPUT["brief"]), call("outline", one, digested + OUTPUT["brief"] + PROMPT_OVERHEAD, zero, OUTPUT["outline"])]
    paid = set()
    for step in ("sections", "activities", "questions"):
        own = NODE_INPUT[step]
        if routes[step][0] not in PREFIX_CACHE:
            rows.append(call(step, F.col("nodes"), prefix + own, zero, OUTPUT[step]))
            continue
        first = routes[step] not in paid
        if first:
            paid.add(routes[step])
            rows.append(call(step, one, prefix + own, zero, OUTPUT[step]))
        rows.append(call(step, F.col("nodes") - int(first), F.lit(own), prefix, OUTPUT[step]))
    written = F.col("nodes") * sum(OUTPUT[s] for s in ("sections", "activities", "questions"))
    rows.append(call("review", one, F.round(written.cast("decimal(18,0)") * F.lit(str(REVIEW_INPUT_FACTOR)).cast("decimal(4,1)"), 0), zero, OUTPUT["review"]))
    each = F.transform(F.coalesce("digest", F.array().cast("array<struct<calls:bigint,miss:bigint>>")), lambda d: call("digest", d["calls"], d["miss"], zero, OUTPUT["digest"]))
    return known.select("jobid", F.explode(F.concat(F.array(*rows), each)).alias("c")).select("jobid", "c.*").where("calls > 0")


def priced_at(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobid, at``: off-peak jobs at the next off-peak hour, others now."""
    return jobs.select(F.col("id").alias("jobid"), F.when(F.col("offpeak"), pricing.next_offpeak(now)).otherwise(now).alias("at"))


def job_forecasts(jobs: DataFrame, sources: DataFrame, now: Column, book: DataFrame | None = None, routes: dict[str, tuple[str, str]] = ROUTES, window: int = DIGEST_WINDOW) -> DataFrame:
    """``jobid, cost, tokensin, tokensout`` of ``jobs(id, brief, prompt, offpeak)`` with a margin for repairs.

    Run it again once sources have real token counts; those replace the guesses by file size.
    """
    book = price_book(jobs.sparkSession) if book is None else book
    calls = forecast_calls(jobs, sources, routes, window)
    connector, model = (F.element_at(F.create_map(*[F.lit(x) for s, r in routes.items() for x in (s, r[i])]), F.col("step")) for i in (0, 1))
    calls = calls.join(priced_at(jobs, now), "jobid").select("jobid", "calls", connector.alias("connector"), model.alias("model"), F.col("miss").alias("tokensin"), F.col("out").alias("tokensout"), F.col("hit").alias("tokenscached"), "at")
    margin = F.lit(str(REPAIR_MARGIN)).cast("decimal(4,2)")
    total = lambda c: F.sum(F.col("calls").cast("decimal(10,0)") * c)
    whole = lambda c: F.round(c.cast("decimal(20,0)") * margin, 0).cast("long")
    return call_costs(calls, book, "at").groupBy("jobid").agg(
        F.round(total(F.col("price")).cast("decimal(24,6)") * margin, 6).cast("decimal(18,6)").alias("cost"),
        whole(F.sum(F.col("calls") * (F.col("tokensin") + F.col("tokenscached")))).alias("tokensin"),
        whole(F.sum(F.col("calls") * F.col("tokensout"))).alias("tokensout"),
    )
