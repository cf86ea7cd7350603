"""Queries of jobs, versions, checkpoints and generated content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fenced, rendered
from ..operators import generation as G
from ..operators import jobs as J
from ..operators import schema
from ..operators.settings import site_settings
from ..sources.tables import relation, table
from .registry import query

KINDS = "coalesce(case mimetype when 'application/pdf' then 'pdf' when 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' then 'docx' when 'text/plain' then 'txt' when 'text/markdown' then 'md' end, case regexp_extract(lower(filename), '\\.([^.]*)$', 1) when 'pdf' then 'pdf' when 'docx' then 'docx' when 'xlsx' then 'xlsx' when 'txt' then 'txt' when 'md' then 'md' end)"


@query(f"select id, {KINDS} as type from source", ("source",))
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "source").select("id", J.source_type(F.col("mimetype"), F.col("filename")).alias("type"))


@query(
    f"""with new as (select id % 400 as jobid, * exclude (jobid) from source where id % 2 = 0), held as (select id % 400 as jobid, count(*) as held from source where id % 2 = 1 group by 1)
    select jobid, count(*) as files, bool_and({KINDS} is not null and filesize <= 20000) and count(*) + coalesce(any_value(held), 0) <= 4 as admitted from new left join held using (jobid) group by 1""",
    ("source",),
)
def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "source").withColumn("jobid", F.col("id") % 400)
    return J.admitted(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 4, 20000)


@query(
    """with digests as (select *, case id % 5 when 0 then null when 1 then '{"title": ' when 2 then '' else '{"title": "a"}' end as digest from source)
    select jobid, cast(row_number() over (partition by jobid order by id) as int) as place, 'src' || id as key, length(text) as chars from digests where status = 'digested' and text <> '' and id % 5 > 2""",
    ("source",),
)
def loadable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 5
    digest = F.when(k == 0, None).when(k == 1, '{"title": ').when(k == 2, "").otherwise('{"title": "a"}')
    return J.loadable_sources(relation(spark, sf_dir, "source").withColumn("digest", digest)).select("jobid", "place", "key", F.char_length("text").cast("long").alias("chars"))


CONTEXT = "case when courseid <> 0 then 'course:' || courseid when categoryid <> 0 then 'category:' || categoryid else 'system' end"
ALLOWED = f"contexts as (select *, {CONTEXT} as context from job), allowed as (select distinct context from contexts where courseid % 3 = 1 or categoryid % 4 = 2)"


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = relation(spark, sf_dir, "job")
    return jobs.where("courseid % 3 = 1 or categoryid % 4 = 2").select(J.context_of(F.col("courseid"), F.col("categoryid")).alias("context")).distinct()


@query(f"with {ALLOWED} select id, context from contexts where context in (select context from allowed) order by timecreated desc, id desc limit 25 offset 50", ("job",))
def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the jobs in allowed contexts: pages of 25 are the feature."""
    return J.page(J.visible(relation(spark, sf_dir, "job"), allowed(spark, sf_dir)), 2).select("id", "context")


@query(f"with {ALLOWED} select id, context from contexts where context in (select context from allowed)", ("job",))
def visible_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.visible(relation(spark, sf_dir, "job"), allowed(spark, sf_dir)).select("id", "context")


@query(f"with {ALLOWED} select count(*) as n from contexts where context in (select context from allowed)", ("job",))
def visible_job_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.visible_count(relation(spark, sf_dir, "job"), allowed(spark, sf_dir))


VERSIONS = "versions as (select l_orderkey as jobid, max(l_suppkey) as version, 'h' || (max(l_suppkey) % 3) as hash from lineitem group by l_orderkey, l_suppkey)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jobid"), F.col("l_suppkey").alias("version")).distinct()
    return key.withColumn("hash", F.concat(F.lit("h"), (F.col("version") % 3).cast("string")))


@query(f"with {VERSIONS} select jobid, max(version) as version, arg_max(hash, version) as hash from versions group by 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_versions(versions(spark, sf_dir))


@query(
    f"""with {VERSIONS}, wanted as (select o_orderkey as jobid, o_custkey % 12 as version from orders)
    select w.jobid, w.version, case when w.version > 0 then (select max(v.version) from versions v where v.jobid = w.jobid and v.version = w.version) else (select max(v.version) from versions v where v.jobid = w.jobid) end as found from wanted w"""
)
def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobid"), (F.col("o_custkey") % 12).alias("version"))
    return J.versions_or_latest(versions(spark, sf_dir), wanted)


@query("select userid from job union select userid from call_log union select userid from budget where userid % 2 = 0", ("job", "call_log", "budget"))
def users_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.users_with_data(relation(spark, sf_dir, "job"), relation(spark, sf_dir, "call_log"), relation(spark, sf_dir, "budget").where("userid % 2 = 0"))


@query("select c_custkey as userid from customer where exists (select 1 from job where userid = c_custkey) or exists (select 1 from call_log where userid = c_custkey)", ("job", "call_log"))
def user_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.has_data(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("userid")), relation(spark, sf_dir, "job"), relation(spark, sf_dir, "call_log"))


@query(
    f"""with {VERSIONS}, chunks as (select jobid, id as sourceid, i as chunkindex from source, range(0, 3) t(i) where i <= id % 3),
    s as (select jobid, string_agg(id || '=' || status, ';' order by id) as t from source group by 1),
    p as (select jobid, string_agg(step || '=' || nodekey || '=' || status, ';' order by timecreated, step, nodekey, status) as t from step group by 1),
    c as (select jobid, string_agg(sourceid || '=' || chunkindex, ';' order by sourceid, chunkindex) as t from chunks group by 1),
    v as (select jobid, string_agg(version::varchar, ';' order by version) as t from versions group by 1),
    j as (select userid, string_agg(id || ':' || status || '|' || coalesce(s.t, '') || '|' || coalesce(p.t, '') || '|' || coalesce(c.t, '') || '|' || coalesce(v.t, ''), '/' order by id) as t
        from job left join s on s.jobid = id left join p on p.jobid = id left join c on c.jobid = id left join v on v.jobid = id group by 1),
    l as (select userid, string_agg(id || '=' || status, ';' order by id) as t from call_log group by 1), b as (select userid, string_agg(period, ';' order by period) as t from budget group by 1)
    select c_custkey as userid, md5(coalesce(j.t, '') || '#' || coalesce(l.t, '') || '#' || coalesce(b.t, '')) as digest
    from customer left join j on j.userid = c_custkey left join l on l.userid = c_custkey left join b on b.userid = c_custkey""",
    ("job", "source", "step", "call_log", "budget"),
)
def user_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's document, read back: a digest of its jobs with all that they hold, of its calls and budgets, in order."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("userid"))
    read = lambda name: relation(spark, sf_dir, name)
    chunks = read("source").select("jobid", F.col("id").alias("sourceid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3)).alias("chunkindex"), F.lit(1).alias("tokencount"))
    made = J.export(users, read("job"), read("source"), read("step"), read("call_log"), chunks, versions(spark, sf_dir), read("budget"))
    job = "struct<jobid:long,status:string,sources:array<struct<id:long,status:string>>,steps:array<struct<step:string,nodekey:string,status:string>>,chunks:array<struct<sourceid:long,chunkindex:long>>,blueprints:array<struct<version:long>>>"
    document = F.from_json("document", f"jobs array<{job}>, calls array<struct<id:long,status:string>>, budgets array<struct<period:string>>")
    texts = lambda rows, *fields: F.coalesce(F.array_join(F.transform(rows, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), ";"), F.lit(""))
    one = lambda j: F.concat(j["jobid"].cast("string"), F.lit(":"), j["status"], F.lit("|"), F.concat_ws("|", texts(j["sources"], "id", "status"), texts(j["steps"], "step", "nodekey", "status"), texts(j["chunks"], "sourceid", "chunkindex"), texts(j["blueprints"], "version")))
    whole = made.select("userid", document.alias("d"))
    jobs = F.coalesce(F.array_join(F.transform("d.jobs", one), "/"), F.lit(""))
    return whole.select("userid", F.md5(F.concat_ws("#", jobs, texts(F.col("d.calls"), "id", "status"), texts(F.col("d.budgets"), "period"))).alias("digest"))


@query(
    """with gone as (select c_custkey as userid from customer where c_nationkey = 7), dead as (select id from job where userid in (select userid from gone))
    select 'job' as name, count(*) as rows from job where userid not in (select userid from gone) union all select 'log', count(*) from call_log where userid not in (select userid from gone)
    union all select 'source', count(*) from source where jobid not in (select id from dead) union all select 'step', count(*) from step where jobid not in (select id from dead)""",
    ("job", "call_log", "source", "step"),
)
def user_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: relation(spark, sf_dir, name)
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("userid"))
    kept = J.without_users(gone, read("job"), read("call_log"), {"source": read("source"), "step": read("step")})
    out = None
    for name, rows in kept.items():
        n = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.union(n)
    return out


@query(
    f"""with {VERSIONS}, last as (select jobid, max(version) as version from versions group by 1), made as (select jobid, count(*) as steps, count(*) filter (status = 'error') as failed from step group by 1)
    select id as jobid, status, coalesce(version, 0) as version, coalesce(steps, 0) as steps, coalesce(failed, 0) as failed from job left join last l on l.jobid = id left join made m on m.jobid = id""",
    ("job", "step"),
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_rows(relation(spark, sf_dir, "job"), versions(spark, sf_dir), relation(spark, sf_dir, "step"))


@query(
    """with wanted as (select distinct jobid, inputhash from step union select l_orderkey, 'h' || (l_suppkey % 50) from lineitem)
    select jobid, inputhash from wanted w where not exists (select 1 from step s where s.jobid = w.jobid and s.inputhash = w.inputhash and s.status in ('done', 'manual') and s.output is not null and s.output not in ('', '[]', '{}', 'null'))""",
    ("step",),
)
def checkpoint_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = relation(spark, sf_dir, "step")
    more = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jobid"), F.concat(F.lit("h"), (F.col("l_suppkey") % 50).cast("string")).alias("inputhash"))
    return J.pending(steps.select("jobid", "inputhash").union(more).distinct(), steps)


@query("select jobid, inputhash, count(*) as attempts from step group by 1, 2", ("step",))
def step_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.attempts(relation(spark, sf_dir, "step"))


@query("select p_partkey, sha256('{\"jobid\":' || p_partkey || ',\"step\":\"' || p_type || '\",\"zinput\":{\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}}') as inputhash from part")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is given in another order for every other row; the hash does not see it."""
    size, brand = (F.lit("size"), F.col("p_size").cast("string")), (F.lit("brand"), F.col("p_brand"))
    given = F.when(F.col("p_partkey") % 2 == 0, F.create_map(*size, *brand)).otherwise(F.create_map(*brand, *size))
    return table(spark, sf_dir, "part").select("p_partkey", J.input_hash({"step": F.col("p_type"), "jobid": F.col("p_partkey")}, given).alias("inputhash"))


@query("select id, case when status <> 'success' then 'error' when userid % 3 = 0 then 'manual' else 'done' end as finished from call_log", ("call_log",))
def step_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "call_log").select("id", J.finished_status(F.col("status") == "success", F.col("userid") % 3 == 0).alias("finished"))


@query(
    """with saves as (select user_id as jobid, event_id as seq, cast(event_id % 2 + user_id % 2 as varchar) as hash from events), marked as (select *, case when hash = lag(hash) over (partition by jobid order by seq) then 0 else 1 end as new from saves)
    select jobid, seq, cast(sum(new) over (partition by jobid order by seq rows unbounded preceding) as bigint) as version, new = 1 as is_new from marked"""
)
def saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = table(spark, sf_dir, "events").select(F.col("user_id").alias("jobid"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 + F.col("user_id") % 2).cast("string").alias("hash"))
    return J.saved_versions(saves)


@query(
    f"""with {VERSIONS}, last as (select jobid, max(version) as version, arg_max(hash, version) as hash, case when max(version) % 5 = 0 then 'approved' else 'draft' end as status from versions group by 1),
    saves as (select o_orderkey as jobid, v.version - case when o_custkey % 4 = 0 then 1 else 0 end as base, 'h' || (o_custkey % 3) as hash, o_custkey % 2 = 0 as approve, o_custkey % 5 as errors from orders left join last v on v.jobid = o_orderkey)
    select jobid, case when version is null then 'missing' when base <> version then 'stale' when approve and s.hash = l.hash and errors = 0 and status = 'draft' then 'approved' when approve then 'not approved' when s.hash = l.hash and status = 'draft' then 'unchanged' else 'saved' end as outcome
    from saves s left join last l using (jobid)"""
)
def save_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = J.latest_versions(versions(spark, sf_dir)).withColumn("status", F.when(F.col("version") % 5 == 0, "approved").otherwise("draft"))
    orders = table(spark, sf_dir, "orders").join(last.select(F.col("jobid").alias("j"), "version"), F.col("o_orderkey") == F.col("j"), "left")
    k = F.col("o_custkey")
    saves = orders.select(F.col("o_orderkey").alias("jobid"), (F.col("version") - (k % 4 == 0).cast("int")).alias("base"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("hash"), (k % 2 == 0).alias("approve"), (k % 5).alias("errors"))
    return J.save_outcomes(saves, last)


# Generated questions: line items are questions of nodes (orders), part keys say which objective they ask

ASKED = "asked as (select l_orderkey as node, l_partkey * 1000 + l_suppkey as pos, 'o' || (l_partkey % 4) as objective, l_partkey % 4 < 3 as known from lineitem)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("o"), (F.col("l_partkey") % 4).cast("string")).alias("objective"), (F.col("l_partkey") % 4 < 3).alias("known"))


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.explode(F.array(F.lit("o0"), F.lit("o1"), F.lit("o2"))).alias("objective"))


@query(f"with {ASKED}, ranked as (select *, row_number() over (partition by node, objective order by pos) as nth from asked) select node, pos, objective, known from ranked where not known or nth <= 1")
def questions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_per_objective(asked(spark, sf_dir), F.lit(1))


SHORT = "goals as (select o_orderkey as node, unnest(['o0', 'o1', 'o2']) as objective from orders), short as (select node, objective, 2 - count(pos) as missing from goals left join asked using (node, objective) group by 1, 2 having count(pos) < 2)"


@query(f"with {ASKED}, {SHORT} select * from short")
def question_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortfalls(objectives(spark, sf_dir), asked(spark, sf_dir), F.lit(2))


FREE = "numbers as (select o_orderkey as node, unnest(range(o_orderkey * 1000 + 1, o_orderkey * 1000 + 9)) as number from orders), free as (select node, number, cast(row_number() over (partition by node order by number) as int) as place from numbers anti join (select l_orderkey as node, l_orderkey * 1000 + l_linenumber as number from lineitem) using (node, number))"


def free(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_orderkey") * 1000
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (first + 1).alias("first"), (first + 8).alias("last"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("number"))
    return G.free_ids(ranges, used)


@query(f"with {FREE} select node, place, number from free")
def question_free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return free(spark, sf_dir)


@query(
    f"""with {ASKED}, {SHORT}, {FREE},
    offered as (select node, pos + 7 as pos, objective, row_number() over (partition by node, objective order by pos) as nth from asked where pos % 5 <> 0),
    kept as (select node, pos, objective, cast(row_number() over (partition by node order by pos) as int) as place from offered join short using (node, objective) where nth <= missing)
    select node, pos, objective, number from kept join free using (node, place)"""
)
def question_fill_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir)
    offered = rows.select("node", (F.col("pos") + 7).alias("pos"), "objective", (F.col("pos") % 5 != 0).alias("valid"))
    return G.filled_in(G.shortfalls(objectives(spark, sf_dir), rows, F.lit(2)), offered, free(spark, sf_dir))


@query("select l_orderkey as node, l_partkey * 1000 + l_suppkey as pos from lineitem where l_partkey % 6 > 1 and l_suppkey % 7 <> 0 and l_suppkey % 5 <> 0 and l_partkey % 4 < 3 and l_orderkey in (select o_orderkey from orders)")
def questions_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    text = F.when(part % 6 == 0, "").when(part % 6 == 1, "0").otherwise("q1")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), (part * 1000 + supp).alias("pos"), F.concat(F.lit("o"), (part % 4).cast("string")).alias("objective"), text.alias("id"), F.when(supp % 7 != 0, "good").alias("feedback"), F.lit("hard").alias("difficulty"), F.when(supp % 5 != 0, F.array(F.lit("src1"))).alias("refs"))
    return G.settled(rows, objectives(spark, sf_dir)).select("node", "pos")


@query(
    """select p_partkey, least(15, greatest(5, a)) as least, least(15, greatest(least(15, greatest(5, a)), case when b = 0 then 15 else b end)) as most,
        case when m > 0 then least(12, greatest(1, cast(ceil(m / 80) as int))) else 0 end as fewest, case when m > 0 then least(12, greatest(least(12, greatest(1, cast(ceil(m / 80) as int))), cast(floor(m / 30) as int))) else 0 end as largest
    from (select p_partkey, cast(p_partkey % 20 as int) as a, cast(p_partkey % 23 as int) as b, cast(p_partkey % 1300 as int) as m from part)"""
)
def content_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: (F.col("p_partkey") % m).cast("int")
    least, most = G.question_limits(n(20), n(23))
    fewest, largest = G.section_range(n(1300))
    return table(spark, sf_dir, "part").select("p_partkey", least.alias("least"), most.alias("most"), fewest.alias("fewest"), largest.alias("largest"))


OUTLINE = "outline as (select o_orderkey as job, cast(row_number() over (partition by o_orderkey order by s, u) - 1 as int) as place, 's' || s || case when u = 0 then '' else '-' || u end as node from orders, lateral (select unnest(range(1, 2 + o_custkey % 3)) as s) a, lateral (select unnest(range(0, 1 + o_custkey % 2)) as u) b)"


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    name = lambda s: F.concat(F.lit("s"), s.cast("string"))
    section = lambda s: F.struct(name(s).alias("id"), F.when(k % 2 == 1, F.array(F.concat(name(s), F.lit("-1")))).otherwise(F.array().cast("array<string>")).alias("subs"))
    return G.fan_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), section).alias("sections")))


@query(f"with {OUTLINE} select job, place, node from outline")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir)


@query(
    f"""with {OUTLINE}, parts as (select l_orderkey as job, 's' || (l_linenumber % 4) as node, cast(l_suppkey % 3 as int) as part, l_partkey * 1000 + l_suppkey as pos, 'a' || l_partkey as id from lineitem)
    select job, node, coalesce(string_agg(id, ',' order by part, pos, id), '') as activities from outline left join parts using (job, node) group by 1, 2"""
)
def bp_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat(F.lit("s"), (F.col("l_linenumber") % 4).cast("string")).alias("node"), (F.col("l_suppkey") % 3).alias("part"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("id"))
    part = lambda n: items.where(F.col("part") == n).drop("part")
    return G.assembled(outline(spark, sf_dir).select("job", "node"), part(0), part(1), part(2)).withColumn("activities", F.array_join("activities", ","))


@query("select distinct jobid as job, nodekey as node from step where status in ('manual', 'failed') and step in ('sections', 'activities', 'questions')", ("step",))
def manual_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "step").withColumnsRenamed({"jobid": "job", "nodekey": "node"})
    return G.manual_nodes(*[rows.where(F.col("step") == s) for s in ("sections", "activities", "questions")])


@query(
    """with nodes as (select distinct jobid as job, nodekey as node, step from step), results as (select jobid as job, nodekey as node, step, max(output) as output from step where status = 'done' and output is not null group by 1, 2, 3)
    select job, node, step, coalesce(output, '{"id":"' || node || '","type":"' || case step when 'sections' then 'label' when 'activities' then 'assign' else 'quiz' end || '","needs_review":true}') as output, output is null as placeholder from nodes left join results using (job, node, step)""",
    ("step",),
)
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "step").withColumnsRenamed({"jobid": "job", "nodekey": "node"})
    results = rows.where("status = 'done' and output is not null").groupBy("job", "node", "step").agg(F.max("output").alias("output"))
    return G.with_placeholders(rows.select("job", "node", "step").distinct(), results)


@query(
    """select event_id, case when event_id % 31 = 0 then 'timeout' when code >= 400 then 'http' when event_id % 7 = 0 then 'truncated' when event_id % 3 = 0 and event_id % 4 >= 2 then 'repair_exhausted' when event_id % 3 = 0 then 'validation' when event_id % 5 = 0 then 'cleaned' when event_id % 4 > 0 then 'repaired' end as reason,
        event_id % 31 = 0 or code in (429, 500, 502, 503, 504, 529) as retry from (select event_id, case user_id % 8 when 0 then 429 when 1 then 404 when 2 then 503 else 200 end as code from events)"""
)
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    code = F.when(F.col("user_id") % 8 == 0, 429).when(F.col("user_id") % 8 == 1, 404).when(F.col("user_id") % 8 == 2, 503).otherwise(200)
    reason = G.failure_reason(k % 7 == 0, F.when(k % 3 == 0, 1).otherwise(0), k % 4, code, k % 31 == 0, k % 5 == 0)
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"), G.retryable(code, k % 31 == 0).alias("retry"))


@query("select jobid, cast(floor(sum(case when status = 'pending' then 0 when status in ('failed', 'digested') then 3 when filesize % 2 = 1 then 2 else 1 end) * 100 / (count(*) * 3)) as int) as percent from source group by 1", ("source",))
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ingest_progress(relation(spark, sf_dir, "source").withColumn("chunks", F.col("filesize") % 2))


@query(
    """with per as (select id % 700 as jobid, bool_or(status = 'digested') as d, bool_or(id % 5 = 0) as r from source group by 1)
    select c_custkey as jobid, case when d is null then 'failed: no sources' when d then 'generate' when r then 'failed: no digest' else 'failed: nothing read' end as outcome from customer left join per on jobid = c_custkey""",
    ("source",),
)
def ingest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = relation(spark, sf_dir, "source").select((F.col("id") % 700).alias("jobid"), "status", F.when(F.col("id") % 5 == 0, "txt").alias("extractor"))
    return G.ingest_outcome(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("jobid")), sources)


@query(
    """with rows as (select id, case when status = 'paused' then case when id % 2 = 0 then 'ingesting' else 'generating' end else status end as at, id % 101 as progress, id % 12 as finished from job)
    select id, cast(case "at" when 'ingesting' then floor((progress + 1) / 2) when 'generating' then 50 + least(45, 5 * finished) when 'review' then 100 when 'approved' then 100 when 'building' then 100 when 'finished' then 100 else 0 end as int) as percent from rows""",
    ("job",),
)
def shown_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return relation(spark, sf_dir, "job").select("id", G.shown_progress(F.col("status"), k % 101, k % 12, F.when(k % 2 == 0, "ingest").otherwise("generate")).alias("percent"))


@query(
    r"""select doc_id, md5('Read ' || regexp_replace(regexp_replace(text, '(?m)^(Re|The)([^\n]*)$', '<<<SOURCE', 'g'), '(?m)^(<<<)?(SOURCE|END)[ \t]*$', ' \1\2', 'g') || ' of {{source}} by ' || source || '.') as digest from documents"""
)
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that start with some words become markers, which the fence then moves in."""
    marked = F.regexp_replace("text", r"(?m)^(Re|The)([^\n]*)$", "<<<SOURCE")
    text = F.concat(fenced(marked, ("SOURCE", "END")), F.lit(" of {{source}}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rendered("Read {{text}} by {{source}}.", {"text": text, "source": F.col("source")})).alias("digest"))


@query("select event_id, event_type as kind, user_id as n from events")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers broken in eight ways; what they hold is read back."""
    k, kind, n = F.col("event_id") % 8, F.col("event_type"), F.col("user_id").cast("string")
    plain = F.concat(F.lit('{"kind": "'), kind, F.lit('", "n": '), n)
    broken = (
        F.when(k == 0, F.concat(F.lit("Sure!\n```json\n"), plain, F.lit("}\n```\nDone.")))
        .when(k == 1, F.concat(F.lit("Here [1]: "), plain, F.lit("} and [more]")))
        .when(k == 2, F.concat(plain, F.lit(", }")))
        .when(k == 3, F.concat(plain, F.lit(', "list": [1, 2')))
        .when(k == 4, F.concat(plain, F.lit(', "ok": True, "none": None, "s": "None, } //"}')))
        .when(k == 5, F.concat(F.lit("{// a note\n"), F.substring(plain, 2, 1 << 20), F.lit("/* end */}")))
        .when(k == 6, F.concat(plain, F.lit(', "cut": "half')))
        .otherwise(F.concat(F.lit("{'kind': '"), kind, F.lit("', 'note': 'it\\'s \"so\"', 'n': "), n, F.lit("}")))
    )
    whole = G.repaired_json(G.json_block(broken))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(whole, "$.kind").alias("kind"), F.get_json_object(whole, "$.n").cast("long").alias("n"))


NUMBER = {"type": "object", "additionalProperties": False, "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 10}, "of": {"type": "string"}}}


def obliging(request: str) -> str:
    """A provider that gives the number it is asked for: some kinds of request it fails at, answers badly at first, or never answers well."""
    kind, n = request.rsplit("|", 2)[-2:] if "Document: " not in request else ("again", "".join(c for c in request.rsplit("Document: ", 1)[1].split('"n":', 1)[-1] if c.isdigit()))
    if kind == "down":
        raise ConnectionError(request)
    if kind == "again":
        if int(n) % 3 == 2:
            return "I can not."
        return json.dumps({"n": int(n) + (10 if int(n) % 3 else 5)})
    return {"words": "no object here", "plain": f'{{"n": 1{n}}}', "more": f'See [1]: {{"n": 1{n}, "why": "so"}}', "small": f'{{"n": {n}}}'}[kind]


@query(
    """with wanted as (select l_orderkey as jobid, 'h' || (l_partkey % 50) as inputhash, min(l_suppkey % 10) as n, min(l_partkey % 5) as k from lineitem group by 1, 2),
    todo as (select * from wanted w where not exists (select 1 from step s where s.jobid = w.jobid and s.inputhash = w.inputhash and s.status in ('done', 'manual') and s.output is not null and s.output not in ('', '[]', '{}', 'null')))
    select jobid, inputhash, case when k in (1, 2) or k = 4 and (n % 3 = 1 or n % 3 = 0 and n >= 5) then 'done' else 'error' end as status,
        case when k in (1, 2) then '{"n":1' || n || '}' when k = 4 and n % 3 = 1 then '{"n":' || (n + 10) || '}' when k = 4 and n % 3 = 0 and n >= 5 then '{"n":' || (n + 5) || '}' end as output,
        case when k in (0, 1, 2) then 1 when k = 3 or n % 3 = 0 and n < 5 then 3 else 2 end as calls,
        case when k = 0 then 'provider' when k = 1 then null when k = 2 then 'cleaned' when k = 3 then 'unreadable' when n % 3 = 2 then 'validation' when n % 3 = 0 and n < 5 then 'repair_exhausted' else 'repaired' end as reason
    from todo""",
    ("step",),
)
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without a checkpoint in rounds of calls: numbers are too small, in words, with more keys, or not given at all."""
    items = table(spark, sf_dir, "lineitem")
    wanted = items.groupBy(F.col("l_orderkey").alias("jobid"), F.concat(F.lit("h"), (F.col("l_partkey") % 50).cast("string")).alias("inputhash")).agg(F.min(F.col("l_suppkey") % 10).alias("n"), F.min(F.col("l_partkey") % 5).alias("k"))
    kind = F.element_at(F.array(*map(F.lit, ("down", "plain", "more", "words", "small"))), (F.col("k") + 1).cast("int"))
    prompt = F.concat(F.lit("A number, please|"), kind, F.lit("|"), F.col("n").cast("string"))
    made = G.answers(wanted.select("jobid", "inputhash", prompt.alias("prompt")), relation(spark, sf_dir, "step"), obliging, lambda v: schema.stripped(v, NUMBER))
    return made.drop("errors")


@query(
    """with outlines as (select id as job, id % 700 as minutes, id % 14 as sections from job), ranges as (select *, case when minutes > 0 then least(12, greatest(1, ceil(minutes / 80.0))) else 0 end as low from outlines),
    issues as (select l_orderkey as job, l_linenumber - 1 as place, case when l_partkey % 5 > 0 then 's' || (l_partkey % 4) end as node from lineitem)
    select job, '/sections' as path, 'sections for the minutes' as rule from ranges where minutes > 0 and not sections between low and least(12, greatest(low, floor(minutes / 30.0)))
    union all select job, '/issues/' || place || '/node', 'broken reference' from issues i where node is null or not exists (select 1 from lineitem l where l.l_orderkey = i.job and 's' || l.l_linenumber = i.node)
    union all select p_partkey, '', 'empty digest' from part where p_partkey % 2 = 0 and p_partkey % 3 <> 1 and p_size % 4 = 0""",
    ("job",),
)
def step_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What outlines, reviews and digests have to hold beside their schemas."""
    items, k = table(spark, sf_dir, "lineitem"), F.col("id")
    outlines = G.outline_errors(relation(spark, sf_dir, "job").select(k.alias("job"), (k % 700).alias("minutes"), (k % 14).alias("sections")))
    node = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("s"), (F.col("l_partkey") % 4).cast("string")))
    issues = items.select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).alias("place"), node.alias("node"))
    nodes = items.select(F.col("l_orderkey").alias("job"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("id"))
    n = F.col("p_partkey")
    digests = table(spark, sf_dir, "part").select(n.alias("job"), (n % 2).alias("concepts"), F.when(n % 3 == 1, 1).alias("definitions"), (F.col("p_size") % 4).alias("objectives"), F.lit(0).alias("procedures"))
    return outlines.union(G.review_errors(issues, nodes)).union(G.digest_errors(digests))


#: What a step's answer looks like: activities of some kinds, each with content of its own.
ANSWER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["activities", "id"],
    "properties": {"id": {"type": "string", "pattern": "^s[0-9]+$"}, "activities": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/activity"}}},
    "$defs": {
        "activity": {
            "type": "object", "additionalProperties": False, "required": ["title", "type"],
            "properties": {"type": {"enum": ["page", "url", "quiz"]}, "title": {"type": "string", "minLength": 1, "maxLength": 40}, "content": {"type": "object"}, "minutes": {"oneOf": [{"type": "null"}, {"type": "integer", "minimum": 1}]}},
            "allOf": [{"if": {"properties": {"type": {"const": "url"}}}, "then": {"required": ["content"], "properties": {"content": {"$ref": "#/$defs/link"}}}}],
        },
        "link": {"type": "object", "additionalProperties": False, "minProperties": 1, "properties": {"externalurl": {"type": "string", "pattern": "^https?://"}, "text": {"type": "string"}}},
    },
}
#: Answers by the call's number: right, with extra keys at three depths, with a misnamed key, with errors of other kinds, cut off.
WRITTEN = """written as (select event_id, event_id % 8 as k, '{"activities":[{"title":"' || event_type || '","type":"page"}' as head, '],"id":"s' || user_id || '"' as tail from events),
    answered as (select event_id, k, head || tail || '}' as plain, case k when 0 then head || tail || '}' when 1 then head || tail || ',"note":{"a":[1]}}'
        when 2 then head || ',{"colour":"red","title":"T","type":"page","x":1},{"content":{"externalurl":"https://x.org","more":true},"title":"U","type":"url"}' || tail || ',"z":null}'
        when 3 then head || ',{"content":{"link":"https://x.org"},"title":"U","type":"url"}' || tail || '}' when 4 then head || ',{"minutes":0,"title":"","type":"poem","x":1}' || tail || '}'
        when 5 then '{"activities":[],"id":"x"}' when 6 then head || ',{"title":"U","type":"url"},{"minutes":5,"title":"V","type":"quiz"}' || tail || '}' else head end as answer from written)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = WRITTEN.replace("from events", "from {events}").replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
    rows = spark.sql(f"with {text} select event_id, answer from answered", events=table(spark, sf_dir, "events"))
    return rows.select("event_id", F.try_parse_json("answer").alias("v"))


@query(
    f"""with {WRITTEN} select event_id, case when k in (1, 2) then case k when 1 then plain else replace(replace(replace(replace(answer, '"colour":"red",', ''), ',"x":1', ''), ',"more":true', ''), ',"z":null', '') end when k <> 7 then answer end as output,
        case k when 1 then 1 when 2 then 4 else 0 end as removed, case k when 3 then 1 when 4 then 4 when 5 then 2 when 6 then 1 when 7 then null else 0 end as errors from answered"""
)
def answers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra keys go where that settles the answer; a misnamed one stays, as nothing would be left of its object."""
    rows = _answers(spark, sf_dir).select("event_id", schema.stripped(F.col("v"), ANSWER_SCHEMA).alias("s"))
    return rows.select("event_id", F.to_json("s.output").alias("output"), "s.removed", F.when(F.col("s.errors").isNotNull(), F.size("s.errors")).alias("errors"))


@query(
    f"""with {WRITTEN}, found as (select event_id, k, unnest(case k when 1 then ['|additionalProperties|note'] when 2 then ['|additionalProperties|z', '/activities/1|additionalProperties|colour,x', '/activities/2/content|additionalProperties|more']
        when 3 then ['/activities/1/content|additionalProperties|link'] when 4 then ['/activities/1|additionalProperties|x', '/activities/1/type|enum|"page","url","quiz"', '/activities/1/title|minLength|', '/activities/1/minutes|oneOf|']
        when 5 then ['/id|pattern|', '/activities|minItems|'] when 6 then ['/activities/1|required|content'] else [] end) as e from answered)
    select event_id, split_part(e, '|', 1) as path, split_part(e, '|', 2) as keyword, split_part(e, '|', 3) as keys from found"""
)
def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every answer that can be read, at its path."""
    rows = _answers(spark, sf_dir).select("event_id", F.explode(schema.errors(F.col("v"), ANSWER_SCHEMA)).alias("e"))
    return rows.select("event_id", "e.path", "e.keyword", F.array_join("e.keys", ",").alias("keys"))


#: Sections with links, lessons and pages; some links are no addresses, and every fourth job has no sources.
SECTIONS = """items as (select *, row_number() over () as line from lineitem),
    parts as (select l_orderkey as job, 's' || l_linenumber as node, line, l_partkey as np, i, case (l_partkey + i) % 3 when 0 then 'url' when 1 then 'lesson' else 'page' end as type,
        case (l_partkey + i) % 4 when 0 then 'https://x.org/' || ((l_partkey + i) % 20) when 1 then 'https://y.org/z' when 2 then 'no address' end as url from items, range(0, 3) t(i) where i <= l_partkey % 3),
    pages as (select job, node, line, np, i, k, case (np + k) % 3 when 1 then 'p' || ((np + k) % 4 + 1) when 2 then '' end as id from parts, range(0, 4) t(k) where type = 'lesson')"""


@query(
    f"""with {SECTIONS}, texts as (select o_orderkey as job, 'See https://x.org/' || (o_orderkey % 20) || ' for more.' as text from orders where o_orderkey % 4 <> 0),
    judged as (select p.*, exists (select 1 from texts t where t.job = p.job) as sourced, not (type = 'url' and url is not null) or exists (select 1 from texts t where t.job = p.job and contains(t.text, p.url)) as good from parts p),
    chosen as (select *, good or not sourced or not bool_or(good) over (partition by line) as kept from judged),
    numbered as (select *, coalesce(id, '') = '' and not exists (select 1 from pages o where o.line = p.line and o.i = p.i and o.id = 'p' || (p.k + 1)) as made from pages p),
    ids as (select line, count(*) filter (made) as numbered, string_agg(case when made then 'p' || (k + 1) else coalesce(id, '') end, ',' order by i, k) as pages from numbered join chosen using (line, i) where kept group by line)
    select job, node, np, count(*) filter (kept) as kept, count(*) filter (not kept) as removed, coalesce(any_value(ids.numbered), 0) as numbered, coalesce(any_value(ids.pages), '') as pages, np % 2 = 1 as renamed
    from chosen left join ids using (line) group by line, job, node, np"""
)
def sections_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "named_struct('id', case (l_partkey + k) % 3 when 1 then 'p' || cast((l_partkey + k) % 4 + 1 as string) when 2 then '' end, 'title', cast(l_partkey as string))"
    part = f"""named_struct('type', case (l_partkey + i) % 3 when 0 then 'url' when 1 then 'lesson' else 'page' end,
        'url', case (l_partkey + i) % 4 when 0 then 'https://x.org/' || cast((l_partkey + i) % 20 as string) when 1 then 'https://y.org/z' when 2 then 'no address' end,
        'pages', transform(sequence(0, 3), k -> {page}))"""
    node = "'s' || cast(l_linenumber as string)"
    answers = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as job", f"{node} as node", f"if(l_partkey % 2 = 1, 'other', {node}) as id", f"cast(transform(sequence(0, cast(l_partkey % 3 as int)), i -> {part}) as array<{G.PART}>) as activities")
    texts = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").selectExpr("o_orderkey as job", "'See https://x.org/' || cast(o_orderkey % 20 as string) || ' for more.' as text")
    made = G.normalized_sections(answers, texts)
    ids = F.array_join(F.flatten(F.transform(F.filter("activities", lambda a: a["type"] == "lesson"), lambda a: F.transform(a["pages"], lambda p: F.coalesce(p["id"], F.lit(""))))), ",")
    np = F.coalesce(F.get("activities", F.lit(0))["pages"][0]["title"].cast("long"), F.lit(0))
    return made.select("job", "node", np.alias("np"), F.size("activities").cast("long").alias("kept"), F.col("removed").cast("long").alias("removed"), F.col("numbered").cast("long").alias("numbered"), ids.alias("pages"), "renamed")


@query(
    """with given as (select c_custkey as site, split_part('joblimit,userlimit,alertpercent,parallel,colour', ',', (1 + c_custkey % 5)::int) as name, c_custkey from customer union all select c_custkey, 'sitelimit', c_custkey from customer),
    valued as (select site, name, case c_custkey % 7 when 0 then '50' when 1 then ' 7.5 ' when 2 then '3.255' when 3 then '-1' when 4 then 'many' when 5 then '5' else '2000000' end as v from given),
    numbers as (select site, name, case when regexp_full_match(trim(v), case when name in ('alertpercent', 'parallel') then '[0-9]{1,9}' else '[0-9]{1,9}([.][0-9]{1,2})?' end) then trim(v)::double end as n from valued)
    select site, coalesce(max(n) filter (name = 'joblimit' and n <= 10000), 5)::double as joblimit, coalesce(max(n) filter (name = 'userlimit' and n <= 10000), 20)::double as userlimit, coalesce(max(n) filter (name = 'sitelimit' and n <= 1000000), 200)::double as sitelimit,
        coalesce(max(n) filter (name = 'alertpercent' and n <= 100), 80)::double as alertpercent, coalesce(max(n) filter (name = 'parallel' and n between 1 and 6), 4)::double as parallel from numbers group by 1"""
)
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind: numbers, some out of range, with too many decimals, negative or in words."""
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (1 + k % n).cast("int"))
    value = pick(("50", " 7.5 ", "3.255", "-1", "many", "5", "2000000"), 7).alias("value")
    rows = table(spark, sf_dir, "customer")
    one = rows.select(k.alias("site"), pick(("joblimit", "userlimit", "alertpercent", "parallel", "colour"), 5).alias("name"), value)
    return site_settings(one.union(rows.select(k, F.lit("sitelimit"), value)))


@query(
    """with rows as (select l_orderkey as jobid, 'h' || (l_partkey % 4) as inputhash, l_partkey % 2 = 0 as start, case when l_suppkey % 3 = 0 then 'done' else 'error' end as status, l_linenumber as attempts, l_suppkey from lineitem),
    have as (select jobid, inputhash, max(attempts) as attempts from rows where not start or l_suppkey % 5 = 0 group by 1, 2), more as (select jobid, inputhash, count(*) as more from rows where start group by 1, 2)
    select jobid, inputhash, case when more is null then 'error' else 'running' end as status, (coalesce(attempts, 0) + coalesce(more, 0))::int as attempts from have full join more using (jobid, inputhash)"""
)
def step_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jobid"), F.concat(F.lit("h"), (F.col("l_partkey") % 4).cast("string")).alias("inputhash"), (F.col("l_partkey") % 2 == 0).alias("start"), F.lit("error").alias("status"), F.col("l_linenumber").cast("int").alias("attempts"), "l_suppkey")
    return J.started(rows.where("not start or l_suppkey % 5 = 0"), rows.where("start"))


@query(
    """select event_id, event_type || '/' || (event_id % 3) as name, event_id % 9 as attempt, case when event_id % 4 = 0 then (event_id % 50)::double else (event_id % 10) / 10.0::double * least(30, 2 ** (event_id % 9 - 1)) end as wait
    from events where event_type || '/' || (event_id % 3) like '%ch%/1' or event_type like 'c__c_'"""
)
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by pattern, and how long each waits before it is tried again."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("/"), (k % 3).cast("string")).alias("name"), (k % 9).alias("attempt"), "event_type")
    wait = G.retry_wait(k % 9, F.when(k % 4 == 0, k % 50), (k % 10) / F.lit(10.0))
    return rows.where(F.col("name").like("%ch%/1") | F.col("event_type").like("c__c_")).select("event_id", "name", "attempt", wait.alias("wait"))
