from pyspark.sql import functions as F

from docloom.functions import pricing as P
from docloom.operators import budget, pricing
from docloom.plans.money import ledger_events

PEAK, OFF = 1791961200, 1791979560  # Wednesday 07:00 and 12:06 UTC


def test_peak_and_next_offpeak(spark):
    at = [PEAK, OFF, PEAK - 3 * 86400 - 4 * 3600, PEAK + 3 * 86400]
    rows = spark.createDataFrame([(t,) for t in at], "t long").select(P.is_peak(F.col("t")), P.next_offpeak(F.col("t")) - F.col("t")).collect()
    assert [tuple(r) for r in rows] == [(True, 3 * 3600), (False, 0), (False, 0), (False, 0)]


def test_durations(spark):
    asked = {"Durata: 120 de minute": 120, "90 min": 90, "1 oră": 60, "2,5 ore": 150, "1.5 hours": 90, "in 45minutes": 45, "version 1.2.3 minutes": 0, "none": 0, "12 minutesx": 0}
    df = spark.createDataFrame(list(asked.items()), "p string, want int")
    assert all(r[0] == r[1] for r in df.select(P.duration_minutes(F.lit(None).cast("string"), F.col("p")), "want").collect())
    assert df.limit(1).select(P.duration_minutes(F.lit('{"duration_minutes": 30}'), F.col("p"))).first()[0] == 30


def forecast(spark, now, tokens=100_000, offpeak=False, routes=pricing.ROUTES):
    jobs = spark.createDataFrame([(1, None, "x", offpeak)], "id long, brief string, prompt string, offpeak boolean")
    sources = spark.createDataFrame([(1, 1, "digested", tokens, 1, "application/pdf", "a.pdf")], "id long, jobid long, status string, tokencount long, filesize long, mimetype string, filename string")
    return pricing.job_forecasts(jobs, sources, F.lit(now).cast("long"), routes=routes).first()


def test_forecast_halves_off_peak_and_without_cache_costs_more(spark):
    flash = dict.fromkeys(pricing.ROUTES, ("deepseek", "deepseek-flash"))
    peak, off = (float(forecast(spark, t, routes=flash)["cost"]) for t in (PEAK, OFF))
    assert abs(off / peak - 0.5) < 0.02
    assert forecast(spark, PEAK, offpeak=True, routes=flash)["cost"] == forecast(spark, OFF, routes=flash)["cost"]
    # the two runs that are published were within a quarter of the forecast
    assert abs(float(forecast(spark, PEAK, 101_520, routes=flash)["cost"]) / 0.3365 - 1) < 0.25
    assert abs(float(forecast(spark, OFF, 101_520, routes=flash)["cost"]) / 0.2205 - 1) < 0.25


def plain_ledger(events, site_limit):
    spent, held, out = {}, {}, []
    for e in sorted(events, key=lambda e: (e["period"], e["at"], e["call"], e["kind"])):
        used = lambda who, e=e: sum(spent.get((e["period"], who), [0, 0]))
        user, site = (spent.setdefault((e["period"], who), [0, 0]) for who in (e["userid"], "site"))
        if e["kind"] == "reserve":
            if e["limit"] > 0 and used(e["userid"]) + e["amount"] > e["limit"]:
                what = "refused by user"
            elif site_limit > 0 and used("site") + e["amount"] > site_limit:
                what = "refused by site"
            else:
                what, held[e["period"], e["call"]] = "reserved", e["amount"]
                user[1] += e["amount"]
                site[1] += e["amount"]
        elif (e["period"], e["call"]) in held:
            what, had = e["kind"] + ("d" if e["kind"] == "release" else "d"), held.pop((e["period"], e["call"]))
            what = "settled" if e["kind"] == "settle" else "released"
            for row in (user, site):
                row[1] -= had
                row[0] += e["amount"] if e["kind"] == "settle" else 0
        else:
            what = "nothing held"
        out.append((e["call"], e["kind"], what, *user))
    return sorted(out)


def test_reservations_against_a_plain_fold(spark, sf):
    events = ledger_events(spark, sf).where("userid > 0")
    rows = [r.asDict() for r in events.collect()]
    for site_limit in (0, 3_000_000, 12_000_000, 30_000_000, 10**12):  # the middle ones bind after some free hours
        got = budget.reservations(events, site_limit).collect()
        assert sorted((r["call"], r["kind"], r["outcome"], r["spent"], r["reserved"]) for r in got) == plain_ledger(rows, site_limit)


def test_two_reservations_cannot_both_pass(spark):
    rows = [("2024-01", 1, 1, "reserve", 6, 10, 1), ("2024-01", 1, 2, "reserve", 6, 10, 1), ("2024-01", 1, 1, "release", 0, 10, 2), ("2024-01", 1, 3, "reserve", 6, 10, 3)]
    df = spark.createDataFrame(rows, "period string, userid long, call long, kind string, amount long, limit long, at long")
    assert {(r["call"], r["kind"]): r["outcome"] for r in budget.reservations(df).collect()} == {(1, "reserve"): "reserved", (2, "reserve"): "refused by user", (1, "release"): "released", (3, "reserve"): "reserved"}
