"""Queries of content shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..operators import content as O
from ..sources.tables import table
from .registry import query


@query("select p_partkey, cast(epoch(try_cast(case when regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then d end as date)) as bigint) as midnight from (select p_partkey, (1990 + p_partkey % 40) || '-' || case when p_partkey % 9 = 0 then '2' else lpad(cast(p_partkey % 14 as varchar), 2, '0') end || '-' || lpad(cast(p_partkey % 33 as varchar), 2, '0') as d from part)")
def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.concat((1990 + k % 40).cast("string"), F.lit("-"), F.when(k % 9 == 0, "2").otherwise(two(k % 14)), F.lit("-"), two(k % 33))
    return table(spark, sf_dir, "part").select("p_partkey", C.midnight(date).alias("midnight"))


@query(
    """select p_partkey, t as tracking, case when t = 2 then case when q then cast(coalesce(v, false) as int) else cast(v as int) end end as view, case when t = 2 then case when q then cast(coalesce(u, false) or coalesce(p, false) as int) else cast(u as int) end end as usegrade,
        case when t = 2 then case when q then cast(coalesce(p, false) as int) else cast(p as int) end end as passgrade, case when t = 2 then 'completionposts' end as rules
    from (select p_partkey, cast(p_partkey % 3 as int) as t, p_partkey % 2 = 0 as q, case when p_partkey % 5 < 3 then p_partkey % 5 = 0 end as v, case when p_partkey % 7 < 4 then p_partkey % 7 = 0 end as u, case when p_partkey % 11 < 6 then p_partkey % 11 = 1 end as p from part)"""
)
def completion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 2, "auto").when(k % 3 == 1, "manual").otherwise("none")
    some = lambda m, most, at: F.when(k % m < most, k % m == at)
    args = (mode, some(5, 3, 0), some(7, 4, 0), some(11, 6, 1), F.create_map(F.lit("completionposts"), k, F.lit("posts"), k, F.lit("completion9"), k))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, C.completion(*args, quiz=True)).otherwise(C.completion(*args)).alias("c"))
    return rows.select("p_partkey", "c.tracking", "c.view", "c.usegrade", "c.passgrade", F.array_join(F.map_keys("c.rules"), ",").alias("rules"))


ENTRIES = "entries as (select user_id as owner, event_id as pos, case when event_id % 9 = 0 then ' <b> </b>' when event_id % 2 = 0 then upper(event_type) || '  ' || (event_id % 4) else '<i>' || event_type || '</i> ' || (event_id % 4) end as title from events)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, four = F.col("event_id"), (F.col("event_id") % 4).cast("string")
    title = F.when(k % 9 == 0, " <b> </b>").when(k % 2 == 0, F.concat(F.upper("event_type"), F.lit("  "), four)).otherwise(F.concat(F.lit("<i>"), "event_type", F.lit("</i> "), four))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), k.alias("pos"), title.alias("title"), (k % 3 > 0).alias("sub"))


TITLED = "titled as (select owner, pos, trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as title from entries)"


@query(f"with {ENTRIES}, {TITLED}, ranked as (select *, row_number() over (partition by owner, lower(title) order by pos) as nth from titled where title <> '') select owner, pos, title from ranked where nth = 1")
def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct_entries(entries(spark, sf_dir).drop("sub"))


@query(f"with {ENTRIES}, {TITLED} select owner, cast(row_number() over (partition by owner order by pos) as int) as page, title, pos % 3 > 0 and row_number() over (partition by owner order by pos) > 1 as sub from titled")
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chapters(entries(spark, sf_dir))


@query("select conv_id, turn, text, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda t: substr(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 255)), lambda t: t <> ''), '|') as options from conversations")
def choice_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_join(C.options(F.split("text", r"\.", -1)), "|").alias("options"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s, case j when 'this' then 0 when 'p1' then case when place < 1 then 1 else 0 end when 'p3' then case when place < 3 then 1 else 0 end else 1 end) as score,
        case j when 'end' then -9 when 'this' then 0 when 'p1' then 101 when 'p3' then 103 else -1 end as jump, case when l_partkey % 2 = 0 then 2 else least(20, n) end as answers
    from (select *, case when l_partkey % 4 = 0 then cast(l_suppkey % 3 as int) end as s, split_part('next,end,this,p1,p3,p9', ',', cast(l_partkey % 6 + 1 as int)) as j, l_suppkey % 4 as place, 2 + cast(l_suppkey % 25 as int) as n from lineitem)"""
)
def lesson_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    jump = F.expr("split_part('next,end,this,p1,p3,p9', ',', cast(l_partkey % 6 + 1 as int))")
    pages = lambda *n: F.create_map(F.lit("p1"), F.lit(n[0]), F.lit("p3"), F.lit(n[1]))
    given = F.transform(F.sequence(F.lit(1), (supp % 25 + 3).cast("int")), lambda i: F.struct(F.when(i == 2, "<p> </p>").otherwise("yes").alias("text")))
    answers = C.lesson_answers(given, F.when(part % 2 == 0, "truefalse").otherwise("multichoice"))
    score = C.lesson_score(F.when(part % 4 == 0, (supp % 3).cast("int")), F.when(jump != "next", jump), supp % 4, pages(1, 3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), C.lesson_jump(jump, pages(101, 103)).alias("jump"), F.size(answers).alias("answers"))


@query(
    """select p_partkey, case when p_partkey % 13 > 0 then '<question type="' || t || '"><name><text><![CDATA[' || p_name || ']]></text></name><questiontext><text><![CDATA[x ]]]]><![CDATA[> y]]></text></questiontext><answer fraction="' || f
        || '"><text><![CDATA[' || p_brand || ']]></text></answer><answer fraction="-25"><text><![CDATA[no]]></text></answer></question>' end as xml
    from (select *, split_part('multichoice,essay,numerical', ',', cast(p_partkey % 3 + 1 as int)) as t, split_part('100,50,33.333,12.5,0', ',', cast(p_partkey % 5 + 1 as int)) as f from part)"""
)
def question_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 13 == 0, "multianswer").otherwise(F.expr("split_part('multichoice,essay,numerical', ',', cast(p_partkey % 3 + 1 as int))"))
    fraction = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.5, 0.33333, 0.125, 0.0)]), (k % 5 + 1).cast("int"))
    answers = F.array(F.struct(F.col("p_brand").alias("text"), fraction.alias("fraction")), F.struct(F.lit("no").alias("text"), F.lit(-0.25).alias("fraction")))
    return table(spark, sf_dir, "part").select("p_partkey", C.question_xml(kind, F.col("p_name"), F.lit("x ]]> y"), answers).alias("xml"))
