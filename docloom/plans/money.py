"""Queries of budgets, prices and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing as price
from ..operators import budget, pricing, usage
from ..sources.tables import relation, table
from .registry import doubles, query

#: Wednesday 14 October 2026, 07:00 UTC, within peak hours.
NOW = 1791961200

LIMIT = "coalesce(limitusd, case when userid = 0 then 200 else 20 end)"
STANDING = f"""standing as (
    select userid, period, {LIMIT} as lim, spentusd + reservedusd as used,
        case when {LIMIT} > 0 then cast(spentusd + reservedusd as double) / cast({LIMIT} as double) * 100 else 0.0 end as percent from budget),
    states as (
        select userid, period, cast(lim as double) as "limit", cast(used as double) as used, cast(percent as double) as percent,
            case when lim <= 0 then 'ok' when used >= lim then 'exceeded' when percent >= 80 then 'alert' else 'ok' end as state,
            cast(case when lim > 0 then greatest(0, lim - used) else -1 end as double) as remaining, lim > 0 and percent >= 80 as at_alert
        from standing)"""
PEAK = "(isodow(make_timestamp(cast({0} as bigint) * 1000000)) <= 5 and (hour(make_timestamp(cast({0} as bigint) * 1000000)) between 1 and 3 or hour(make_timestamp(cast({0} as bigint) * 1000000)) between 6 and 9))"
PRICES = """prices(connector, model, miss, hit, output, off_miss, off_hit, off_output) as (values
    ('deepseek', 'deepseek-flash', 0.3000, 0.0060, 1.2000, 0.1500, 0.0030, 0.6000), ('deepseek', 'deepseek-v4-pro', 1.3200, 0.0440, 3.9600, 0.6600, 0.0220, 1.9800))"""


def _cost(tokensin: str, tokenscached: str, tokensout: str, peak: str) -> str:
    part = lambda n, on, off: f"cast({n} as decimal(12,0)) * cast(case when {peak} then prices.{on} else prices.{off} end as decimal(10,4))"
    return f"coalesce(cast(round({part(tokensin, 'miss', 'off_miss')} + {part(tokenscached, 'hit', 'off_hit')} + {part(tokensout, 'output', 'off_output')}, 0) as decimal(18,0)) * 0.000001, 0)"


@query(f"with {STANDING} select * from states", ("budget",))
def budget_limits_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(budget.standing(relation(spark, sf_dir, "budget")))


@query(
    f"""with {STANDING}, users as (select distinct o_custkey as userid from orders)
    select userid, coalesce(remaining, case when userid = 0 then 200 else 20 end) as remaining from users left join (select * from states where period = '2024-01') s using (userid)""",
    ("budget",),
)
def budget_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("userid")).distinct()
    return doubles(budget.remaining(users, relation(spark, sf_dir, "budget").where("period = '2024-01'")))


@query(
    f"""with {STANDING}, users as (select distinct o_custkey as userid from orders),
    rest as (select userid, coalesce(remaining, case when userid = 0 then 200 else 20 end) as remaining from users left join (select * from states where period = '2024-01') s using (userid))
    select id as jobid, estimatedcost <= 5 and (remaining < 0 or estimatedcost <= remaining) and estimatedcost <= 4.5 as within, actualcost < 5 and remaining <> 0 as resumable from job join rest using (userid)""",
    ("budget", "job"),
)
def budget_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = relation(spark, sf_dir, "job")
    left = budget.remaining(jobs.select("userid").distinct(), relation(spark, sf_dir, "budget").where("period = '2024-01'"))
    return budget.gates(jobs, left, F.lit("4.5").cast("decimal(18,6)"))


@query("select id, strftime(make_timestamp(timecreated * 1000000), '%Y-%m') as period, actualcost + estimatedcost > 5 as refused from job", ("job",))
def budget_job_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.lit(5).cast("decimal(18,6)")
    return relation(spark, sf_dir, "job").select("id", usage.period_of(F.col("timecreated")).alias("period"), budget.refused_by_job(F.col("actualcost"), F.col("estimatedcost"), five).alias("refused"))


CHARGES = """charges as (select case when id % 2 = 0 then 0 else userid end as userid, strftime(make_timestamp(timecreated * 1000000), '%Y-%m') as period, id, timecreated, case when id % 9 = 0 then -3 * cost else cost end as amount from call_log)"""


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all charges are the site's, so its key holds half of the rows; every ninth is a refund."""
    log = relation(spark, sf_dir, "call_log")
    return log.select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("userid")).alias("userid"), usage.period_of(F.col("timecreated")).alias("period"), "id", "timecreated", F.when(F.col("id") % 9 == 0, -3 * F.col("cost")).otherwise(F.col("cost")).cast("decimal(12,6)").alias("amount"))


@query(
    f"""with {CHARGES}, sums as (select *, case when userid = 0 then 20 else 0.5 end as lim, sum(amount) over (partition by userid, period order by timecreated, id rows unbounded preceding) as spent from charges),
    flags as (select *, spent * 100 >= lim * 80 as reached, coalesce(lag(spent) over (partition by userid, period order by timecreated, id), 0) * 100 >= lim * 80 as before from sums)
    select userid, period, id, cast(spent as double) as spent, case when reached then 1 else -1 end as edge from flags where reached <> before""",
    ("call_log",),
)
def budget_alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("userid") == 0, F.lit("20")).otherwise(F.lit("0.5")).cast("decimal(12,6)")
    return doubles(budget.alert_edges(charges(spark, sf_dir), limit))


@query("select coalesce(jobid, 0) * 1000 + userid as batch, count(*) as calls, cast(sum(cost) as double) as estimate, sum(cost) <= 0.25 as admitted from call_log group by 1", ("call_log",))
def budget_batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = relation(spark, sf_dir, "call_log").select((F.coalesce("jobid", F.lit(0)) * 1000 + F.col("userid")).alias("batch"), F.col("cost").alias("estimate"))
    return doubles(budget.admitted_batches(calls, F.lit("0.25").cast("decimal(18,6)")))


@query("select jobid, cast(greatest(0, sum(cost)) as double) as actualcost from call_log where jobid is not null group by 1", ("call_log",))
def job_actual_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(budget.job_actual_costs(relation(spark, sf_dir, "call_log")))


@query(
    """with events as (select *, case when id % 2 = 0 then 'stop' else 'resume' end as event from job),
    moved as (select id, status, case when event = 'stop' and status in ('queued', 'ingesting', 'generating') then 'paused' when event = 'resume' and status = 'paused' then 'queued' end as next from events)
    select id as jobid, status, coalesce(next, status) as after, next is not null as allowed from moved""",
    ("job",),
)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.transitions(relation(spark, sf_dir, "job"), F.when(F.col("id") % 2 == 0, "stop").otherwise("resume"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call reserves, and half an hour later settles or, if it failed, releases."""
    log = relation(spark, sf_dir, "call_log")
    micro = (F.col("cost") * 1_000_000).cast("long")
    base = log.select(usage.period_of(F.col("timecreated")).alias("period"), "userid", F.col("id").alias("call"), "status", micro.alias("micro"), F.col("timecreated").alias("at"))
    limit = (F.col("userid") % 5 * 1_000_000).cast("long").alias("limit")
    first = base.select("period", "userid", "call", F.lit("reserve").alias("kind"), (F.col("micro") * 2).alias("amount"), limit, "at")
    kind = F.when(F.col("status") == "error", "release").otherwise("settle").alias("kind")
    return first.union(base.select("period", "userid", "call", kind, F.col("micro").alias("amount"), limit, (F.col("at") + 1800).alias("at")))


#: One month's events as a list, folded with the outcomes so far as the state: an event looks up its user's last outcome and that of its own call's reservation.
LEDGER_SQL = """with micros as (select strftime(make_timestamp(cast(timecreated as bigint) * 1000000), '%Y-%m') as period, userid, id as call, status, cast(cost * 1000000 as bigint) as micro, cast(userid % 5 * 1000000 as bigint) as lim, timecreated as moment from call_log),
    happened as (select period, userid, call, 'reserve' as kind, micro * 2 as amount, lim, moment from micros
        union all select period, userid, call, case when status = 'error' then 'release' else 'settle' end, micro, lim, moment + 1800 from micros),
    numbered as (select *, row_number() over (partition by period order by moment, call, kind) as n from happened),
    linked as (select *, lag(n) over (partition by period, userid order by n) as last_n, min(n) filter (kind = 'reserve') over (partition by period, call) as call_n, max(amount) filter (kind = 'reserve') over (partition by period, call) as held from numbered),
    months as (select period, list(struct_pack(kind := kind, amount := amount, held := held, lim := lim, call_n := call_n, last_n := last_n, site := cast(0 as bigint), what := cast([] as utinyint[]), spent := cast([] as bigint[]), reserved := cast([] as bigint[])) order by n) as events from linked group by period),
    folded as (select period, list_reduce(
        list_prepend(struct_pack(kind := '', amount := cast(0 as bigint), held := cast(0 as bigint), lim := cast(0 as bigint), call_n := cast(0 as bigint), last_n := cast(0 as bigint), site := cast(0 as bigint), what := cast([] as utinyint[]), spent := cast([] as bigint[]), reserved := cast([] as bigint[])), events),
        lambda s, e: list_transform(
            list_transform([struct_pack(kind := e.kind, amount := e.amount, held := e.held, lim := e.lim, site := s.site, mine := s.what[e.call_n], spent := coalesce(s.spent[e.last_n], 0), reserved := coalesce(s.reserved[e.last_n], 0))],
                lambda r: struct_pack(r := r, w := case
                    when r.kind = 'reserve' then case when r.lim > 0 and r.spent + r.reserved + r.amount > r.lim then 2 when r.site + r.amount > 200000000 then 3 else 1 end
                    when r.mine <> 1 then 4 when r.kind = 'settle' then 5 else 6 end)),
            lambda x: struct_pack(kind := e.kind, amount := e.amount, held := e.held, lim := e.lim, call_n := e.call_n, last_n := e.last_n,
                site := x.r.site + case x.w when 1 then x.r.amount when 5 then x.r.amount - x.r.held when 6 then -x.r.held else 0 end, what := list_append(s.what, cast(x.w as utinyint)),
                spent := list_append(s.spent, x.r.spent + case x.w when 5 then x.r.amount else 0 end),
                reserved := list_append(s.reserved, x.r.reserved + case x.w when 1 then x.r.amount when 5 then -x.r.held when 6 then -x.r.held else 0 end)))[1]) as f from months),
    outcomes as (select period, unnest(f.what) as w, unnest(f.spent) as spent, unnest(f.reserved) as reserved, generate_subscripts(f.what, 1) as n from folded)
    select period, userid, call, kind, ['reserved', 'refused by user', 'refused by site', 'nothing held', 'settled', 'released'][w] as outcome, spent, reserved from linked join outcomes using (period, n)"""


@query(LEDGER_SQL, ("call_log",))
def budget_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.reservations(ledger_events(spark, sf_dir))


@query(f"with {PRICES} select id, cast({_cost('tokensin', 'tokenscached', 'tokensout', PEAK.format('timecreated'))} as double) as price, {PEAK.format('timecreated')} as peak from call_log left join prices using (connector, model)", ("call_log",))
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(pricing.call_costs(relation(spark, sf_dir, "call_log"), pricing.price_book(spark)).select("id", "price", "peak"))


@query(f"select connector, count(*) as calls, count(*) filter ({PEAK.format('timecreated')}) as peak_calls from call_log group by 1", ("call_log",))
def peak_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "call_log").groupBy("connector").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(price.is_peak(F.col("timecreated")), 1)).alias("peak_calls"))


BOOKS = """books as (select 'c' || cast({id} % 97 as {text}) as connector, 'm' || cast({id} as {text}) as model,
    case when {id} % 131 = 0 then '' when {id} % 173 = 0 then '-1' else cast(p_size as {text}) || '.5' end as input_miss,
    case when {id} % 211 = 0 then 'x1' else '1e-3' end as input_hit, case when {id} % 307 = 0 then null else '.25' end as output,
    case when {id} % 3 = 0 then null when {id} % 401 = 0 then 'free' else '0' end as cache_write from part)"""
NUMBER = "coalesce(regexp_full_match({0}, '[ \\t]*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t]*') and try_cast({0} as double) >= 0, false)"


@query(f"with {BOOKS.format(id='p_partkey', text='varchar')} select connector, bool_and({NUMBER.format('input_miss')} and {NUMBER.format('input_hit')} and {NUMBER.format('output')} and (cache_write is null or {NUMBER.format('cache_write')})) as valid from books group by 1")
def price_books_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return pricing.valid_price_books(spark.sql(f"with {BOOKS.format(id='p_partkey', text='string')} select * from books"))


WINDOWS = """windows as (select 'c' || cast({id} % 89 as {text}) as connector, case when {id} % 97 = 0 then '8' else cast({id} % 7 + 1 as {text}) end as weekday,
    case when {id} % 113 = 0 then 'six' else cast({id} % 12 as {text}) end as first, case when {id} % 127 = 0 then '25' else cast({id} % 12 + 3 as {text}) end as after from part)"""


@query(f"with {WINDOWS.format(id='p_partkey', text='varchar')} select connector, bool_and(coalesce(try_cast(weekday as double) between 1 and 7 and try_cast(first as double) between 0 and 24 and try_cast(after as double) between 0 and 24, false)) as valid from windows group by 1")
def peak_windows_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return pricing.valid_peak_windows(spark.sql(f"with {WINDOWS.format(id='p_partkey', text='string')} select * from windows"))


@query(
    f"""with {PRICES}, asked as (
        select doc_id as id, split_part('deepseek,anthropic', ',', cast(doc_id % 2 + 1 as int)) as connector, case when doc_id % 2 = 0 then 'deepseek-flash' else 'claude-sonnet' end as model,
            cast(ceil(length(text) / 3.5) as bigint) as tokensin, case when doc_id % 3 = 0 then cast(ceil(length(text) / 3.5) as bigint) else doc_id % 3 * 1000 end as tokensout from documents)
    select id, tokensin, tokensout, cast({_cost('tokensin', '0', 'tokensout', 'true')} as double) as estimate from asked left join prices using (connector, model)"""
)
def precall_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("doc_id") % 2 == 1
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(odd, "anthropic").otherwise("deepseek").alias("connector"), F.when(odd, "claude-sonnet").otherwise("deepseek-flash").alias("model"), F.col("text").alias("input"), (F.col("doc_id") % 3 * 1000).alias("maxtokens"), F.lit(NOW).alias("at"))
    return doubles(pricing.precall_estimates(asked, pricing.price_book(spark)))


USAGE = """replies as (select event_id, split_part('deepseek,anthropic,gemini,openaicompat', ',', cast(event_id % 4 + 1 as int)) as provider,
    case event_id % 8 when 0 then '{"prompt_tokens": ' || a || ', "prompt_cache_hit_tokens": ' || b || ', "completion_tokens": ' || c || '}'
        when 4 then '{"prompt_tokens": ' || a || ', "prompt_cache_hit_tokens": ' || b || ', "prompt_cache_miss_tokens": ' || c || ', "completion_tokens": ' || c || '}'
        when 1 then '{"input_tokens": ' || a || ', "cache_read_input_tokens": ' || b || ', "cache_creation_input_tokens": ' || c || ', "output_tokens": ' || c || '}'
        when 5 then '{"input_tokens": ' || a || ', "output_tokens": ' || c || '}'
        when 2 then '{"promptTokenCount": ' || a || ', "cachedContentTokenCount": ' || b || ', "candidatesTokenCount": ' || c || '}'
        when 3 then '{"prompt_tokens": ' || a || ', "completion_tokens": ' || c || '}' else '{}' end as usage
    from (select event_id, cast(event_id % 500 as {text}) as a, cast(event_id % 300 as {text}) as b, cast(event_id % 200 as {text}) as c from events) t)"""
_J = lambda key: f"coalesce(cast(json_extract_string(usage, '$.{key}') as bigint), 0)"


@query(
    f"""with {USAGE.replace('{text}', 'varchar')} select event_id,
        case provider when 'deepseek' then coalesce(cast(json_extract_string(usage, '$.prompt_cache_miss_tokens') as bigint), greatest(0, {_J('prompt_tokens')} - {_J('prompt_cache_hit_tokens')}))
            when 'anthropic' then {_J('input_tokens')} + {_J('cache_creation_input_tokens')} when 'gemini' then greatest(0, {_J('promptTokenCount')} - {_J('cachedContentTokenCount')}) else {_J('prompt_tokens')} end as tokensin,
        case provider when 'anthropic' then {_J('output_tokens')} when 'gemini' then {_J('candidatesTokenCount')} else {_J('completion_tokens')} end as tokensout,
        case provider when 'deepseek' then {_J('prompt_cache_hit_tokens')} when 'anthropic' then {_J('cache_read_input_tokens')} when 'gemini' then {_J('cachedContentTokenCount')} else 0 end as tokenscached
    from replies"""
)
def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    replies = spark.sql(f"with {USAGE.replace('{text}', 'string')} select * from replies")
    return replies.select("event_id", price.provider_usage(F.col("provider"), F.col("usage")).alias("u")).select("event_id", "u.*")


SIZES = """sized as (select jobid, id as source, cast(coalesce(rawtokens, greatest(1, ceil(filesize / (case
    when contains(lower(mimetype || ' ' || filename), 'pdf') then 70 when contains(lower(mimetype || ' ' || filename), 'wordprocessingml') then 90 when contains(lower(mimetype || ' ' || filename), '.docx') then 90
    when contains(lower(mimetype || ' ' || filename), 'presentationml') then 90 when contains(lower(mimetype || ' ' || filename), '.pptx') then 90
    when contains(lower(mimetype || ' ' || filename), 'spreadsheetml') then 3 when contains(lower(mimetype || ' ' || filename), '.xlsx') then 3 else 5 end)))) as bigint) as tokens
    from source where status <> 'failed')"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation's rawtokens is n_chars / 4, a double; tokens are whole."""
    return relation(spark, sf_dir, "source").withColumn("tokencount", F.round("rawtokens").cast("long"))


@query(f"with {SIZES.replace('rawtokens', 'cast(round(rawtokens) as bigint)')} select * from sized", ("source",))
def source_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.source_sizes(sources(spark, sf_dir))


MINUTES = r"""minutes as (select id, offpeak, coalesce(cast(json_extract_string(brief, '$.duration_minutes') as int), 0) as briefed,
        cast(nullif(replace(regexp_extract(prompt, '(?i)(^|[^0-9.,])([0-9]+([.,][0-9]+)?)\s*(de\s+)?(minutes|minute|min|hours|hour|ore|oră|ora)($|[^\p{L}0-9])', 2), ',', '.'), '') as decimal(12,4)) as figure,
        lower(regexp_extract(prompt, '(?i)(^|[^0-9.,])([0-9]+([.,][0-9]+)?)\s*(de\s+)?(minutes|minute|min|hours|hour|ore|oră|ora)($|[^\p{L}0-9])', 5)) as unit from job),
    durations as (select id, offpeak, case when briefed > 0 then briefed else coalesce(cast(round(figure * case when starts_with(unit, 'min') then 1 else 60 end) as int), 0) end as minutes from minutes),
    nodes as (select *, greatest(3, least(10, cast(round(cast(case when minutes > 0 then minutes else 240 end as decimal(12,0)) / 45) as int))) as sections from durations)"""


@query(f"with {MINUTES} select id as jobid, minutes, cast(sections + sections // 2 as int) as nodes from nodes", ("job",))
def duration_and_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = price.duration_minutes(F.col("brief"), F.col("prompt"))
    return relation(spark, sf_dir, "job").select(F.col("id").alias("jobid"), minutes.alias("minutes"), price.node_count(minutes).alias("nodes"))


@query(
    f"""with recursive hours as (select id, timecreated + (id % 30) * 3600 as moment, 0 as n from job union all select id, moment + 3600, n + 1 from hours where n < 167 and {PEAK.format('moment')})
    select id as jobid, max(moment) as "at" from hours group by 1""",
    ("job",),
)
def offpeak_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "job").select(F.col("id").alias("jobid"), price.next_offpeak(F.col("timecreated") + F.col("id") % 30 * 3600).alias("at"))


FORECAST = f"""
    sums as (select jobid, cast(sum(greatest(1, ceil(tokens / 60000))) as bigint) as windows, cast(sum(tokens) as bigint) as total from sized group by 1),
    jobs as (select id as jobid, sections + sections // 2 as nodes, coalesce(windows, 0) as windows, coalesce(total, 0) as total, case when offpeak then {NOW} + 3 * 3600 else {NOW} end as moment from nodes left join sums on jobid = id),
    calls as (
        select s.jobid, 'digest' as step, unnest(generate_series(1, cast(greatest(1, ceil(tokens / 60000)) as bigint))) as n, least(tokens, 60000) + 1500 as miss, 0 as hit, 3500 as out from sized s
        union all select jobid, 'brief', 1, windows * 3500 + 1500, 0, 800 from jobs
        union all select jobid, 'outline', 1, windows * 3500 + 800 + 1500, 0, 2500 from jobs
        union all select jobid, 'sections', n, case when n = 1 then total + 4800 + 5000 else 5000 end, case when n = 1 then 0 else total + 4800 end, 5000 from (select *, unnest(generate_series(1, nodes)) as n from jobs)
        union all select jobid, 'activities', n, 9000, total + 4800, 2400 from (select *, unnest(generate_series(1, nodes)) as n from jobs)
        union all select jobid, 'questions', n, case when n = 1 then total + 4800 + 20000 else 20000 end, case when n = 1 then 0 else total + 4800 end, 8500 from (select *, unnest(generate_series(1, nodes)) as n from jobs)
        union all select jobid, 'review', 1, round(nodes * 15900 * 2.2), 0, 3000 from jobs),
    priced as (
        select calls.*, {_cost('calls.miss', 'calls.hit', 'calls.out', PEAK.format('moment'))} as cost
        from calls join jobs using (jobid) left join prices on connector = case when step = 'review' then 'gemini' else 'deepseek' end and model = case when step = 'review' then 'gemini-flash' when step in ('outline', 'questions') then 'deepseek-v4-pro' else 'deepseek-flash' end)"""


@query(
    f"""with {MINUTES}, {SIZES.replace('rawtokens', 'cast(round(rawtokens) as bigint)')}, {PRICES}, {FORECAST}
    select jobid, cast(round(sum(cost) * 1.05, 6) as double) as cost, cast(round(sum(miss + hit) * 1.05) as bigint) as tokensin, cast(round(sum(out) * 1.05) as bigint) as tokensout
    from priced where jobid in (select id from job) group by 1""",
    ("job", "source"),
)
def job_cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(pricing.job_forecasts(relation(spark, sf_dir, "job"), sources(spark, sf_dir), F.lit(NOW).cast("long")))


@query("select l_orderkey, l_linenumber, step, least(393216, case when configured > 0 then configured else case step when 'digest' then 8192 when 'brief' then 4096 when 'sections' then 32768 when 'questions' then 32768 when 'repair' then 32768 else 16384 end end) as \"limit\" from (select l_orderkey, l_linenumber, split_part('digest,brief,outline,sections,activities,questions,review,repair,other', ',', cast(l_partkey % 9 + 1 as int)) as step, cast((l_suppkey % 5 - 1) * 150000 as int) as configured from lineitem)")
def output_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("split_part('digest,brief,outline,sections,activities,questions,review,repair,other', ',', cast(l_partkey % 9 + 1 as int))").alias("step"), ((F.col("l_suppkey") % 5 - 1) * 150000).cast("int").alias("configured"))
    return rows.select("l_orderkey", "l_linenumber", "step", price.output_limit(F.col("step"), F.col("configured")).alias("limit"))


@query("select c_custkey, coalesce(nullif(trim(own), ''), nullif(trim(common), ''), 'deepseek') as connector from (select c_custkey, split_part(' ,gemini, anthropic ', ',', cast(c_custkey % 3 + 1 as int)) as own, split_part('openaicompat,  ', ',', cast(c_custkey % 2 + 1 as int)) as common from customer)")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.expr("split_part(' ,gemini, anthropic ', ',', cast(c_custkey % 3 + 1 as int))")
    common = F.expr("split_part('openaicompat,  ', ',', cast(c_custkey % 2 + 1 as int))")
    return table(spark, sf_dir, "customer").select("c_custkey", price.routed(own, common, "deepseek").alias("connector"))
