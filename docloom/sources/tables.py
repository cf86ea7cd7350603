"""Parquet tables, and relations of the data model derived from them for queries and tests.

A relation is one SQL text that Spark and another SQL engine both run; the few spellings
that differ are written ``@name(arguments)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPELLINGS = {
    "spark": {
        "epoch": "unix_timestamp(cast({0} as timestamp))",
        "json": "cast(get_json_object({0}, '$.{1}') as bigint)",
        "upto": "lateral view explode(sequence(0, cast({0} as int) - 1)) as {1}",
        "unit": "cast(cast({0} as decimal(18,0)) * 0.000001bd as decimal(12,6))",
        "month": "date_format({0}, 'yyyy-MM')",
    },
    "duckdb": {
        "epoch": "cast(floor(epoch({0})) as bigint)",
        "json": "cast(json_extract_string({0}, '$.{1}') as bigint)",
        "upto": "cross join lateral (select unnest(range(0, {0})) as {1})",
        "unit": "cast(cast({0} as decimal(18,0)) * 0.000001 as decimal(12,6))",
        "month": "strftime({0}, '%Y-%m')",
    },
}

#: One row per provider call; amounts are whole micro-dollars, so that no engine has to round.
RELATIONS = {
    "call_log": """
        select event_id as id, user_id as userid, nullif(event_id % 40, 0) as jobid, event_type as step,
            split_part('deepseek,anthropic,gemini', ',', cast(user_id % 3 + 1 as int)) as connector,
            split_part('deepseek-flash,claude-sonnet,gemini-flash,deepseek-v4-pro,claude-sonnet,gemini-pro', ',', cast(user_id % 6 + 1 as int)) as model,
            case event_id % 3 when 0 then 's' || cast(event_id % 5 as varchar(20)) when 1 then 's' || cast(event_id % 5 as varchar(20)) || 'w' || cast(event_id % 4 as varchar(20)) else 'outline' end as nodekey,
            @json(props;k) * 10 as tokensin, @json(props;k) * 3 as tokensout, @json(props;k) * 5 as tokenscached,
            @unit(round(value * 1000)) as cost, cast(round(value * 100) as bigint) as durationms,
            case when event_type = 'error' then 'error' else 'success' end as status, @epoch(ts) as timecreated
        from {events}""",
    "long_log": """
        select o_orderkey as id, o_custkey as userid, o_orderkey % 500 as jobid, o_orderpriority as step,
            split_part('deepseek,anthropic,gemini', ',', cast(o_custkey % 3 + 1 as int)) as connector, 'm' || cast(o_custkey % 6 as varchar(20)) as model,
            o_orderkey % 9000 as tokensin, o_orderkey % 700 as tokensout, o_orderkey % 4000 as tokenscached,
            @unit(round(o_totalprice * 100)) as cost, case when o_orderstatus = 'F' then 'error' else 'success' end as status, @epoch(o_orderdate) as timecreated
        from {orders}""",
    "budget": """
        select c_custkey as userid, '2024-0' || cast(c_custkey % 3 + 1 as varchar(20)) as period,
            case c_custkey % 5 when 0 then null when 1 then 0.00 else cast(c_custkey % 40 as decimal(12,2)) end as limitusd,
            @unit(round(abs(c_acctbal) * 2500)) as spentusd, @unit(c_custkey % 7 * 250000) as reservedusd
        from {customer}""",
    "job": """
        select o_orderkey as id, o_custkey as userid, split_part('draft,queued,ingesting,generating,paused,review,approved,building,finished,failed,cancelled', ',', cast(o_orderkey % 11 + 1 as int)) as status,
            case when o_orderkey % 3 = 0 then 0 else o_orderkey % 50 end as courseid, case when o_orderkey % 5 = 0 then 0 else o_orderkey % 20 end as categoryid,
            split_part('Course on safety|Durata: 120 de minute|a 90 min lesson|about 2,5 ore|1.5 hours of it|Take 3 hours, no more|in 45minutes|version 1.2 minutes|7 weeks', '|', cast(o_orderkey % 9 + 1 as int)) as prompt,
            case when o_orderkey % 4 = 0 then '{{"duration_minutes": ' || cast(o_orderkey % 700 as varchar(20)) || '}}' end as brief,
            o_orderkey % 2 = 0 as offpeak, @unit(round(o_totalprice * 10)) as estimatedcost, @unit(round(o_totalprice * 8)) as actualcost, @epoch(o_orderdate) as timecreated
        from {orders}""",
    "source": """
        select doc_id as id, doc_id % 100 as jobid, 'File ' || cast(doc_id as varchar(20)) || split_part('.PDF,.docx,.txt,.xlsx,.md,.bin', ',', cast(doc_id % 6 + 1 as int)) as filename,
            split_part('application/pdf,application/vnd.openxmlformats-officedocument.wordprocessingml.document,text/plain,application/octet-stream,text/markdown,image/png', ',', cast(doc_id % 6 + 1 as int)) as mimetype,
            n_chars as filesize, split_part('pending,extracted,digested,failed', ',', cast(doc_id % 4 + 1 as int)) as status, case when doc_id % 3 = 0 then cast(null as bigint) else n_chars / 4 end as rawtokens, text
        from {documents}""",
    "step": """
        select l_orderkey as jobid, split_part('digest,brief,outline,sections,activities,questions,review', ',', cast(l_linenumber % 7 + 1 as int)) as step,
            case when l_partkey % 4 = 0 then 'outline' else 's' || cast(l_partkey % 9 as varchar(20)) || case when l_partkey % 2 = 0 then 'w1' else '' end end as nodekey,
            'h' || cast(l_partkey % 50 as varchar(20)) as inputhash, split_part('done,manual,error,running,done', ',', cast(l_suppkey % 5 + 1 as int)) as status,
            case when l_suppkey % 6 = 0 then cast(null as varchar(20)) when l_suppkey % 6 = 1 then '[]' else '{{"id": ' || cast(l_partkey as varchar(20)) || '}}' end as output,
            cast(l_quantity as bigint) * 100 as tokensin, cast(l_quantity as bigint) * 30 as tokensout, cast(l_quantity as bigint) * 50 as tokenscached, @unit(round(l_extendedprice)) as cost,
            1 + l_linenumber % 3 as attempts, split_part('cleaned,repaired,http,timeout,validation', ',', cast(l_partkey % 5 + 1 as int)) as reason, @epoch(l_shipdate) as timecreated, @epoch(l_shipdate) + l_partkey as timemodified
        from {lineitem}""",
}
#: A blueprint per order: its line items are sections, with subsections, activities and questions by arithmetic on the part key.
RELATIONS |= {
    "bp_section": """
        select l_orderkey as bp, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as si, 's' || cast(l_linenumber as varchar(20)) as id,
            case when l_partkey % 50 = 0 then repeat('T', 300) else 'Section ' || cast(l_partkey as varchar(20)) end as title, l_partkey % 11 = 0 as review, l_partkey as np
        from {lineitem}""",
    "bp_container": """
        select bp, si, -1 as ui, id, cast(null as varchar(20)) as parent, title, review, np from bp_section
        union all
        select bp, si, cast(i as int) as ui, id || '-' || cast(i as varchar(20)) as id, id as parent, 'Part' as title, np % 13 = i as review, np + 100 * (i + 1) as np from bp_section @upto(1 + np % 2;i) where np % 3 = 0""",
    "bp_activity": """
        select bp, si, ui, cast(i as int) as ai, id as container, id || '.a' || cast(i % 3 as varchar(20)) as id,
            split_part('page,book,label,url,resource,folder,quiz,lesson,assign,forum,glossary,wiki,choice,feedback,h5pactivity,scorm', ',', cast((np + i * 7) % 16 + 1 as int)) as type,
            case when (np + i) % 70 = 0 then repeat('a', 256) else 'Activity' end as title, 'src' || cast((np + i) % 6 as varchar(20)) as ref,
            case when (np + i) % 4 = 0 then 'https://x.org/' || cast((np + i) % 20 as varchar(20)) end as url, (np + i) % 19 = 0 as review, case when (np + i) % 3 = 0 then 'C' || cast((np + i) % 4 as varchar(20)) end as competency,
            case (np + i) % 5 when 0 then 's1.a0' when 1 then 's9.a9' when 2 then id || '.a0' end as need, np + i as na
        from bp_container @upto(1 + np % 4;i)""",
    "bp_question": """
        select bp, si, ui, ai, cast(i as int) as qi, id as activity, 'q' || cast(na % 40 + i as varchar(20)) as id, split_part('multichoice,multichoice,truefalse,shortanswer,numerical,essay,gapselect', ',', cast((na + i) % 7 + 1 as int)) as qtype,
            (na + i) % 7 = 0 as single, container || '.o' || cast(i % 3 as varchar(20)) as objective_ref,
            case (na + i) % 4 when 0 then 'Fill [[1]] and [[2]]' when 1 then 'Fill [[2]] only' when 2 then 'review: see [[1]]' else 'none' end as text, cast(na % 4 as int) as choices,
            cast(case (na + i) % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.3333 else 0.0 end as decimal(6,4)) as f1, cast(case (na + i) % 5 when 0 then 0.5 when 1 then 0.6667 when 2 then 1.0 else -0.25 end as decimal(6,4)) as f2
        from bp_activity @upto(2 + na % 3;i) where na % 3 = 1""",
}
#: Relations that others read.
NEEDS = {"bp_container": ("bp_section",), "bp_activity": ("bp_section", "bp_container"), "bp_question": ("bp_section", "bp_container", "bp_activity")}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def spelled(text: str, engine: str) -> str:
    def one(match: re.Match) -> str:
        return SPELLINGS[engine][match[1]].format(*match[2].split(";"))

    return re.sub(r"@(\w+)\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", one, text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``RELATIONS`` over the tables in ``sf_dir``."""
    parts = [f"{n} as ({RELATIONS[n]})" for n in NEEDS.get(name, ())]
    text = (f"with {', '.join(parts)} " if parts else "") + RELATIONS[name]
    text = spelled(text, "spark").replace("varchar(20)", "string")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def common_tables(names: tuple[str, ...]) -> list[str]:
    """Relations, and what they read, as common table expressions for DuckDB."""
    every = dict.fromkeys(n for name in names for n in (*NEEDS.get(name, ()), name))
    return [f"{n} as ({spelled(RELATIONS[n], 'duckdb').format(**{t: t for t in TABLES})})" for n in every]
