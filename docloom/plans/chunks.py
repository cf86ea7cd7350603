"""Queries of chunks, windows and digests; turns of conversations stand for chunks where SQL has to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunking as C
from ..sources.files import ingested, publish, read_published, shared_folder
from ..sources.tables import relation, table
from .registry import query
from .text import paged

TURNS = """turns as (select conv_id as doc_id, cast(row_number() over (partition by conv_id order by turn, text) - 1 as int) as chunkindex, case when turn % 2 = 0 then 'Turn of ' || role end as title,
    case when turn % 3 = 0 then null else cast(turn as int) end as pagefrom, case when turn % 3 = 0 then null else cast(turn + turn % 2 as int) end as pageto, text as content, cast(ceil(length(text) / 3.5) as bigint) as tokencount from conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations")
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    return rows.select(
        F.col("conv_id").alias("doc_id"), index.alias("chunkindex"), F.when(turn % 2 == 0, F.concat(F.lit("Turn of "), "role")).alias("title"),
        F.when(turn % 3 != 0, turn.cast("int")).alias("pagefrom"), F.when(turn % 3 != 0, (turn + turn % 2).cast("int")).alias("pageto"),
        F.col("text").alias("content"), F.ceil(F.char_length("text") / F.lit(3.5)).cast("long").alias("tokencount"),
    )


WINDOWS = """placed as (
    select doc_id, chunkindex, tokencount, 0 as win, tokencount as total from turns where chunkindex = 0
    union all select t.doc_id, t.chunkindex, t.tokencount, case when p.total + t.tokencount > 400 then win + 1 else win end, case when p.total + t.tokencount > 400 then t.tokencount else p.total + t.tokencount end
    from placed p join turns t on t.doc_id = p.doc_id and t.chunkindex = p.chunkindex + 1)"""


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: packing is a fold that carries headings back. The tests check sizes, order, coverage and overlaps."""
    return C.with_hashes(C.chunks(paged(spark, sf_dir)))


@query()
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.source_totals(C.chunks(paged(spark, sf_dir)))


UNITS = r"""pieces as (select doc_id, unnest(string_split_regex(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '(?m)^([A-ZÀ-Ý][a-zà-ÿ]{1,4} )', '## \1', 'g'), '\n')) as line from documents)"""


@query(f"with {UNITS} select doc_id, count(*) as units, count(*) filter (regexp_matches(line, '^#{{1,6}}\\s+\\S')) as headings, sum(length(trim(line)))::bigint as chars from pieces where trim(line) <> '' group by 1")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as blocks; those with a short first word as headings. Each line is then a unit, for headings end blocks and blank lines part the rest."""
    marked = F.regexp_replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), r"(?m)^([A-ZÀ-Ý][a-zà-ÿ]{1,4} )", "## $1")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.units(F.regexp_replace(marked, "\n", "\n\n"))).alias("u"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col("u.heading"), 1)).alias("headings"), F.sum(F.char_length("u.text")).alias("chars"))


@query(f"with recursive {TURNS}, {WINDOWS} select doc_id, chunkindex, win as \"window\" from placed")
def digest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windows(turns(spark, sf_dir), 400)


@query(
    f"""with recursive {TURNS}, {WINDOWS}, pieces as (
        select doc_id, chunkindex, win, chr(10) || '<<< chunk ' || chunkindex || case when pagefrom is null then '' when pagefrom = pageto then ' | pages ' || pagefrom else ' | pages ' || pagefrom || '-' || pageto end || coalesce(' | title: ' || title, '') || ' >>>' || chr(10) || content || chr(10) as piece
        from turns join placed using (doc_id, chunkindex))
    select doc_id, win as "window", md5('Document: conversation ' || doc_id || chr(10) || string_agg(piece, '' order by chunkindex)) as digest from pieces group by doc_id, win"""
)
def window_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = turns(spark, sf_dir)
    names = made.select("doc_id", F.concat(F.lit("conversation "), F.col("doc_id").cast("string")).alias("filename")).distinct()
    return C.rendered_windows(made, C.windows(made, 400), names).select("doc_id", "window", F.md5("text").alias("digest"))


@query(
    f"""with {TURNS}, pieces as (select doc_id % 5 as jobid, doc_id, chunkindex, chr(10) || content as piece from turns)
    select jobid, doc_id, chunkindex, coalesce(sum(length(piece)) over (partition by jobid order by doc_id, chunkindex rows between unbounded preceding and 1 preceding), 0)::bigint as start, md5(piece) as digest from pieces"""
)
def rebuilt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = turns(spark, sf_dir)
    jobs = made.select("doc_id", (F.col("doc_id") % 5).alias("jobid")).distinct()
    return C.rebuilt(made, jobs).select("jobid", "doc_id", "chunkindex", "start", F.md5("piece").alias("digest"))


@query(f"with {TURNS} select doc_id, chunkindex, sha1(content) as contenthash from turns")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_hashes(turns(spark, sf_dir)).select("doc_id", "chunkindex", "contenthash")


#: Answers: every event is an item of one of four windows of 40 sources; names repeat, some are blank, refs are untidy.
ITEMS = """items as (select event_id % 40 as source, cast(event_id % 4 as int) as win, split_part('concepts,definitions,objectives,procedures', ',', cast(user_id % 4 + 1 as int)) as list, event_id as pos,
    case when event_id % 13 = 0 then '  ' else 'Item  ' || case when event_id % 2 = 0 then 'A' else 'a' end || cast(user_id % 60 as {text}) end as name, case when event_id % 11 = 0 then '' else event_type end as detail,
    cast(user_id % 8 as {text}) as r1, case when event_id % 5 = 0 then 'x' else cast(event_id % 9 as {text}) end as r2 from events)"""
CLEAN = f"""{ITEMS.replace('{text}', 'varchar')},
    named as (select source, win, list, pos, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name, detail, list_distinct_ordered(r1, r2, win) as refs from (select *, win as w from items) i),
    kept as (select *, row_number() over (partition by source, win, list order by pos) as nth from named where name <> '' and (list not in ('definitions', 'procedures') or detail <> '')),
    cleaned as (select * from kept where nth <= case list when 'concepts' then 40 when 'definitions' then 40 else 15 end)""".replace(
    "list_distinct_ordered(r1, r2, win)", "case when r1 = r2 or not regexp_full_match(r2, '[0-9]+') or try_cast(r2 as int) > 3 + win then case when cast(r1 as int) > 3 + win then '' else r1 end when cast(r1 as int) > 3 + win then r2 else r1 || ',' || r2 end"
)


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = spark.sql(f"with {ITEMS.replace('{text}', 'string')} select source, win as window, list, pos, name, detail, array(r1, r2) as refs from items")
    known = rows.select("source", "window").distinct().withColumn("indexes", F.sequence(F.lit(0), F.col("window") + 3))
    return rows, known


@query(f"with {CLEAN} select source, win as \"window\", list, pos, name, detail, refs from cleaned")
def digest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cleaned_items(*items(spark, sf_dir)).withColumn("refs", F.array_join("refs", ","))


@query(
    f"""with {CLEAN},
    firsts as (select *, lower(name) as key, row_number() over (partition by source, list, lower(name) order by win, pos) as nth_name from cleaned),
    refs as (select source, list, key, ref, min(o) as o from (select source, list, key, unnest(string_split(refs, ',')) as ref, win::bigint * 1000000000 + pos * 10 + generate_subscripts(string_split(refs, ','), 1) as o from firsts) where ref <> '' group by all),
    joined as (select source, list, key, string_agg(ref, ',' order by o) as refs from refs group by all)
    select source, list, name, detail, coalesce(j.refs, '') as refs, cast(row_number() over (partition by source, list order by win, pos) as int) as place from (select * exclude (refs) from firsts where nth_name = 1) f left join joined j using (source, list, key)"""
)
def digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merged_items(C.cleaned_items(*items(spark, sf_dir))).withColumn("refs", F.array_join("refs", ","))


@query(
    f"""with {CLEAN}, windows as (select distinct source, win from items)
    select source, win as "window" from windows anti join (select * from cleaned where list = 'procedures' and pos % 3 = 0) c using (source, win)"""
)
def digest_empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = items(spark, sf_dir)
    return C.empty_windows(known, C.cleaned_items(rows, known).where("list = 'procedures' and pos % 3 = 0"))


@query(
    """with answers as (select doc_id % 100 as source, doc_id as win, case when doc_id % 3 = 0 then '' else 'Title ' || doc_id end as title, case when doc_id % 5 = 0 then 'English' when doc_id % 2 = 0 then lang else '' end as language from documents where doc_id % 7 < 3),
    sources as (select distinct doc_id % 110 as source, 'file.' || (doc_id % 110) || '.pdf' as filename, 'und' as language from documents),
    got as (select source, arg_min(title, win) filter (title <> '') as t, arg_min(language, win) filter (language <> '') as l from answers group by 1)
    select source, coalesce(t, regexp_replace(filename, '\\.[^.]*$', '')) as title, case when regexp_full_match(l, '[a-z]{2,3}') then l else language end as language from sources left join got using (source)"""
)
def digest_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    answers = docs.where("doc_id % 7 < 3").select((doc % 100).alias("source"), doc.alias("window"), F.when(doc % 3 == 0, "").otherwise(F.concat(F.lit("Title "), doc.cast("string"))).alias("title"), F.when(doc % 5 == 0, "English").when(doc % 2 == 0, F.col("lang")).otherwise("").alias("language"))
    sources = docs.select((doc % 110).alias("source")).distinct().select("source", F.concat(F.lit("file."), F.col("source").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("und").alias("language"))
    return C.envelopes(answers, sources)


@query("select doc_id, case when length(lang) = 2 and doc_id % 3 > 0 then lang when doc_id % 2 = 0 then 'hu' else 'ro' end as language from documents")
def digest_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    own = F.when(doc % 3 == 0, "und").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", C.digest_language(own, F.when(doc % 2 == 0, "hu-HU")).alias("language"))


@query(
    f"""with {TURNS}, refs as (select o_orderkey as section, o_custkey % 40 as source, cast(case when o_orderkey % 2 = 0 then 0 else o_orderkey % 9 end as int) as chunkindex from orders where o_orderkey % 5 <> 0)
    select section, source, r.chunkindex, md5(content) as digest from refs r join turns t on t.doc_id = source and t.chunkindex = r.chunkindex"""
)
def referenced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ref = F.concat(F.lit("src"), (F.col("o_custkey") % 40).cast("string"), F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("#"), (key % 9).cast("string"))))
    sections = table(spark, sf_dir, "orders").select(key.alias("section"), F.when(key % 5 == 0, F.array(F.lit("chapter 3"))).otherwise(F.array(ref, ref)).alias("refs"))
    return C.referenced_chunks(sections, turns(spark, sf_dir)).select("section", "source", "chunkindex", F.md5("content").alias("digest"))


@query(
    """with read as (select id, id % 4 = 0 as read, jobid, status, rawtokens from source),
    chunks as (select id, i, 10 as tokencount from read, range(0, 3) t(i) where not read and i <= id % 3 union all select id, i, 7 + id % 5 from read, range(0, 2) t(i) where read)
    select id, case when read then 'extracted' else status end as status, case when read then 2 * (7 + id % 5) else rawtokens end as tokencount, case when read then 'en' end as language,
        (select count(*) from chunks c where c.id = r.id) as chunks, (select sum(tokencount)::bigint from chunks c where c.id = r.id) as tokens, case when jobid % 4 = 0 then 5.5 else 1.5 end::double as cost
    from read r""",
    ("source",),
)
def ingest_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the sources is read again: chunks, sources and estimates change in one step, and are read back."""
    k, root = F.col("id"), shared_folder(spark)
    rows = relation(spark, sf_dir, "source")
    sources = rows.select("id", "jobid", "status", F.col("rawtokens").alias("tokencount"), F.lit(None).cast("string").alias("language"))
    chunks = lambda some, n, tokens: some.select(k.alias("sourceid"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunkindex"), tokens.alias("tokencount"))
    jobs = sources.select("jobid").distinct()
    first = {"chunks": chunks(sources, k % 3, F.lit(10).cast("long")), "sources": sources, "estimates": jobs.select("jobid", F.lit(1.5).alias("cost"))}
    publish(spark, root, first, 0)
    old = {name: read_published(spark, root, name, 1) for name in first}
    again = sources.where("id % 4 = 0")
    new = ingested(*old.values(), chunks(again, F.lit(1).cast("long"), 7 + k % 5), again.select("id", F.lit("en").alias("language")), jobs.where("jobid % 4 = 0").select("jobid", F.lit(5.5).alias("cost")))
    publish(spark, root, new, 1)
    got = {name: read_published(spark, root, name) for name in first}
    counts = got["chunks"].groupBy(F.col("sourceid").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokencount").alias("tokens"))
    return got["sources"].join(counts, "id", "left").join(got["estimates"], "jobid").select("id", "status", "tokencount", "language", "chunks", "tokens", "cost")
