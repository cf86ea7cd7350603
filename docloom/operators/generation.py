"""Generated content: what to ask for, what to keep of the answers, and what is still missing.

A call to a provider is the one step that isn't an expression: ``called`` runs it in the
tasks; ``answers`` goes in rounds of calls, over steps that have no checkpoint yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import written
from .jobs import pending

QUESTIONS = (5, 15)
CODES = (429, 500, 502, 503, 504, 529)


def first_per_objective(questions: DataFrame, most: Column) -> DataFrame:
    """The first ``most`` questions of each known objective, in order; questions of unknown objectives stay. ``questions(node, pos, objective, known)``."""
    nth = F.row_number().over(Window.partitionBy("node", "objective").orderBy("pos"))
    return questions.withColumn("nth", nth).where(~F.col("known") | (F.col("nth") <= most)).drop("nth")


def shortfalls(objectives: DataFrame, questions: DataFrame, least: Column) -> DataFrame:
    """``node, objective, missing`` of objectives with too few questions, also of those with none."""
    have = questions.groupBy("node", "objective").agg(F.count(F.lit(1)).alias("have"))
    rows = objectives.join(have, ["node", "objective"], "left").select("node", "objective", (least - F.coalesce("have", F.lit(0))).alias("missing"))
    return rows.where("missing > 0")


def free_ids(ranges: DataFrame, used: DataFrame) -> DataFrame:
    """``node, place, number``: the numbers of each node's range that no question has, ascending. ``ranges(node, first, last)``, ``used(node, number)``."""
    every = ranges.select("node", F.explode(F.sequence("first", "last")).alias("number"))
    free = every.join(used, ["node", "number"], "left_anti")
    return free.select("node", F.row_number().over(Window.partitionBy("node").orderBy("number")).alias("place"), "number")


def filled_in(short: DataFrame, offered: DataFrame, free: DataFrame) -> DataFrame:
    """``node, pos, objective, number``: valid new questions, the first that each short objective lacks, numbered by the node's free ids.

    ``offered(node, pos, objective, valid)``.
    """
    nth = F.row_number().over(Window.partitionBy("node", "objective").orderBy("pos"))
    kept = offered.where("valid").withColumn("nth", nth).join(short, ["node", "objective"]).where("nth <= missing")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("pos")))
    return kept.join(free, ["node", "place"]).select("node", "pos", "objective", "number")


def settled(questions: DataFrame, objectives: DataFrame) -> DataFrame:
    """Questions with an id, feedback and difficulty (``'0'`` counts as empty), refs and a known objective."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "0")
    whole = ~empty("id") & ~empty("feedback") & ~empty("difficulty") & F.col("refs").isNotNull()
    return questions.where(whole).join(objectives, ["node", "objective"], "left_semi")


def question_limits(least: Column, most: Column) -> tuple[Column, Column]:
    """Both within 5 and 15, the second not below the first; 0 is not set."""
    low = F.least(F.lit(QUESTIONS[1]), F.greatest(F.lit(QUESTIONS[0]), least))
    return low, F.least(F.lit(QUESTIONS[1]), F.greatest(low, F.when(most == 0, QUESTIONS[1]).otherwise(most)))


def section_range(minutes: Column) -> tuple[Column, Column]:
    """Fewest and most sections for a course of so many minutes, 80 and 30 minutes each, at most 12; 0 for no minutes."""
    low = F.least(F.lit(12), F.greatest(F.lit(1), F.ceil(minutes / 80)))
    high = F.least(F.lit(12), F.greatest(low, F.floor(minutes / 30)))
    return tuple(F.when(minutes > 0, c).otherwise(0).cast("int") for c in (low, high))


def fan_out(outlines: DataFrame) -> DataFrame:
    """``job, place, node``: sections and subsections in order, each once. ``outlines(job, sections array<struct<id, subs array<string>>>)``."""
    ids = F.flatten(F.transform("sections", lambda s: F.concat(F.array(s["id"]), s["subs"])))
    return outlines.select("job", F.posexplode(F.array_distinct(ids)).alias("place", "node"))


def assembled(outline: DataFrame, material: DataFrame, interactive: DataFrame, quiz: DataFrame) -> DataFrame:
    """``job, node, activities``: the outline's nodes with material, then interactive activities, then the quiz; nodes without any keep an empty list.

    Parts are ``(job, node, pos, id)``.
    """
    parts = material.select("job", "node", F.lit(0).alias("part"), "pos", "id")
    parts = parts.union(interactive.select("job", "node", F.lit(1), "pos", "id")).union(quiz.select("job", "node", F.lit(2), "pos", "id"))
    made = parts.groupBy("job", "node").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "id"))).alias("x"))
    return outline.join(made, ["job", "node"], "left").select("job", "node", F.coalesce("x.id", F.array().cast("array<string>")).alias("activities"))


def manual_nodes(*steps: DataFrame) -> DataFrame:
    """``job, node`` of nodes that any step left to people or failed. Each of ``(job, node, status)``."""
    out = None
    for rows in steps:
        own = rows.where(F.col("status").isin("manual", "failed")).select("job", "node")
        out = own if out is None else out.union(own)
    return out.distinct()


def with_placeholders(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Results by node; a node without one gets a minimal activity flagged for people. ``nodes(job, node, step)``, ``results(job, node, step, output)``."""
    kind = F.when(F.col("step") == "sections", "label").when(F.col("step") == "activities", "assign").otherwise("quiz")
    empty = F.to_json(F.struct(F.col("node").alias("id"), kind.alias("type"), F.lit(True).alias("needs_review")))
    rows = nodes.join(results, ["job", "node", "step"], "left")
    return rows.select("job", "node", "step", F.coalesce("output", empty).alias("output"), F.col("output").isNull().alias("placeholder"))


def failure_reason(truncated: Column, schema_errors: Column, repairs: Column, code: Column, timed_out: Column, cleaned: Column) -> Column:
    """Why a step ended as it did; null for a plain success."""
    return (
        F.when(timed_out, "timeout").when(code >= 400, "http").when(truncated, "truncated")
        .when((schema_errors > 0) & (repairs >= 2), "repair_exhausted").when(schema_errors > 0, "validation")
        .when(cleaned, "cleaned").when(repairs > 0, "repaired")
    )


def retryable(code: Column, network_error: Column) -> Column:
    return network_error | F.coalesce(code.isin(*CODES), F.lit(False))


def retry_wait(attempt: Column, asked: Column, chance: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds until the next try: what the provider asks for, else a share (``chance``, 0 to 1) of a span that doubles with each attempt, up to ``most``."""
    return F.coalesce(asked.cast("double"), chance * F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)))


def ingest_progress(sources: DataFrame) -> DataFrame:
    """``jobid, percent``: each source has three phases: pending 0, failed or digested 3, else 2 with chunks and 1 without. ``sources(jobid, status, chunks)``."""
    done = F.when(F.col("status") == "pending", 0).when(F.col("status").isin("failed", "digested"), 3).when(F.col("chunks") > 0, 2).otherwise(1)
    return sources.groupBy("jobid").agg(F.floor(F.sum(done) * 100 / (F.count(F.lit(1)) * 3)).cast("int").alias("percent"))


def ingest_outcome(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """``jobid, outcome``: generate if any source was digested, else why the job failed. ``jobs(jobid)``, ``sources(jobid, status, extractor)``."""
    per = sources.groupBy("jobid").agg(F.bool_or(F.col("status") == "digested").alias("digested"), F.bool_or(F.col("extractor").isNotNull()).alias("read"))
    outcome = F.when(F.col("digested"), "generate").when(F.col("digested").isNull(), "failed: no sources").when(F.col("read"), "failed: no digest").otherwise("failed: nothing read")
    return jobs.join(per, "jobid", "left").select("jobid", outcome.alias("outcome"))


def shown_progress(status: Column, progress: Column, finished: Column, stage: Column) -> Column:
    """Percent for the job's page: reading is the first half, each finished step five points of the second; a paused job stays where it was."""
    at = F.when(status == "paused", F.when(stage == "ingest", "ingesting").otherwise("generating")).otherwise(status)
    return F.when(at == "ingesting", F.floor((progress + 1) / 2)).when(at == "generating", 50 + F.least(F.lit(45), 5 * finished)).when(at.isin("review", "approved", "building", "finished"), 100).otherwise(0).cast("int")


# Answers


def json_block(text: Column) -> Column:
    """The JSON object in an answer: that of a fenced block which starts with one, else the first balanced one; of a cut answer, to its end.

    It opens at the first ``{``, whatever stands in front of it (citations, lists); marks in strings don't count. Null if there is none.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(\{.*?)```", 1)
    opened = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)(\{.*)\z", 1)
    parts = F.regexp_extract_all(opened, F.lit(rf'(?s){STRING}|[{{}}]|[^"{{}}]++|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        read = s["read"] + F.char_length(part)
        return F.struct(depth.alias("depth"), read.alias("read"), F.when((s["end"] == 0) & (depth == 0), read).otherwise(s["end"]).alias("end"))

    end = F.aggregate(parts, start, step)["end"]
    return F.when(opened == "", None).when(end > 0, F.substr(opened, F.lit(1), end)).otherwise(opened)


STRING = r'"(?:[^"\\]++|\\.)*+"'
#: Comments, strings in either quotes, and what is between them.
LEXEME = rf"(?s)//[^\n]*|/\*.*?\*/|{STRING}|'(?:[^'\\]++|\\.)*+'|[^\"'/]++|."


def repaired_json(text: Column) -> Column:
    """Comments and trailing commas out, Python's literals and quotes as JSON's, open strings and brackets closed; strings stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))

    def mended(part: Column, i: Column) -> Column:
        inner = F.replace(F.replace(F.substr(part, F.lit(2), F.char_length(part) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        quoted = part.rlike(r"(?s)\A'.*'\z") & (F.char_length(part) > 1) & F.get(parts, i - 1).rlike(r"[{\[,:]\s*\z")
        plain = part
        for word, literal in (("True", "true"), ("False", "false"), ("None", "null"), ("NaN", "0")):
            plain = F.regexp_replace(plain, rf"\b{word}\b", literal)
        comment = part.rlike(r"\A/[/*]")
        return F.when(part.startswith('"'), part).when(quoted, F.concat(F.lit('"'), inner, F.lit('"'))).when(comment, "").otherwise(plain)

    text = F.array_join(F.transform(parts, mended), "")
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        opener = F.when(c == "{", "}").when(c == "[", "]")
        free = ~s["inside"]
        stack = F.when(free & opener.isNotNull(), F.concat(opener, s["stack"])).when(free & c.isin("}", "]") & (F.substring(s["stack"], 1, 1) == c), F.substring(s["stack"], 2, 1 << 30)).otherwise(s["stack"])
        inside = F.when((c == '"') & ~s["escaped"], ~s["inside"]).otherwise(s["inside"])
        return F.struct(stack.alias("stack"), inside.alias("inside"), (s["inside"] & (c == "\\") & ~s["escaped"]).alias("escaped"))

    marks = F.regexp_extract_all(text, F.lit(r'(?s)[{}\[\]"]|\\.'), F.lit(0))
    end = F.aggregate(F.transform(marks, lambda m: F.when(F.char_length(m) == 2, "").otherwise(m)), start, step)
    closed = F.concat(text, F.when(end["inside"], '"').otherwise(""), end["stack"])
    return F.regexp_replace(closed, rf"({STRING})|,(?=\s*[}}\]])", "$1")


Provider = Callable[[str], str]
CALLED = "jobid long, inputhash string, content string, failed boolean"
#: Calls for one step after the first.
REPAIRS = 2
KEYS = ["jobid", "inputhash"]


def called(requests: DataFrame, provider: Provider) -> DataFrame:
    """One call for each of ``requests(jobid, inputhash, request)``: ``jobid, inputhash, content, failed``.

    ``provider`` answers a request (and must be picklable); whatever it raises is a failure at the provider.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for job, key, request in batch[["jobid", "inputhash", "request"]].itertuples(index=False):
                try:
                    rows.append((job, key, provider(request), False))
                except Exception:
                    rows.append((job, key, None, True))
            yield pd.DataFrame(rows, columns=["jobid", "inputhash", "content", "failed"])

    return requests.select("jobid", "inputhash", "request").mapInPandas(run, CALLED)


def repair_request(errors: Column, document: Column) -> Column:
    """What asks for a corrected document."""
    return F.concat(F.lit("Correct this document.\nErrors: "), errors, F.lit("\nDocument: "), document)


def answers(wanted: DataFrame, steps: DataFrame, provider: Provider, checked: Callable[[Column], Column], repairs: int = REPAIRS) -> DataFrame:
    """Run the steps of ``wanted(jobid, inputhash, prompt)`` that have no checkpoint: ``jobid, inputhash, status, output, errors, calls, reason``.

    ``checked`` takes the decoded answer (VARIANT, null if it could not be read) and gives ``struct<output, errors, removed>``, as
    ``schema.stripped`` does. Calls go in rounds, each of which is a table that is written before its answers are looked at, so what a round has paid for
    is not paid again if an executor is lost later; within a round only tasks that had not ended call again. After the
    first call at most ``repairs`` more follow for steps that are still wrong:

    - an answer that was never JSON is asked for again, with the same prompt, and an unreadable new one counts as a round;
    - one with errors goes back with them, as the request of ``repair_request``; if what comes is not JSON, nothing more is tried;
    - a failure at the provider ends the step as it stands.

    ``reason`` is null for a plain success, ``cleaned`` or ``repaired`` for others, and ``provider``, ``unreadable``,
    ``validation`` or ``repair_exhausted`` for errors. ``errors`` is JSON. Of repeated steps one is run.
    """
    todo = pending(wanted, steps).groupBy(*KEYS).agg(F.min("prompt").alias("prompt"))
    state = todo.select(*KEYS, "prompt", F.col("prompt").alias("request"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("errors"))
    ended = []
    for calls in range(1, repairs + 2):
        got = written(called(state, provider))
        new = F.try_parse_json(repaired_json(json_block(F.col("content"))))
        rows = got.withColumn("new", new).withColumn("c", checked(F.col("new"))).select(*KEYS, "failed", F.to_json("c.output").alias("made"), F.to_json("c.errors").alias("found"), F.size("c.errors").alias("n"), F.col("c.removed").alias("removed"))
        rows = state.join(rows, KEYS)
        readable, right = F.col("made").isNotNull(), F.coalesce(F.col("n") == 0, F.lit(False))
        before = F.col("output").isNotNull()
        over = F.col("failed") | right | (~readable & before) | F.lit(calls > repairs)
        output, errors = F.coalesce("made", "output"), F.when(readable, F.col("found")).otherwise(F.col("errors"))
        why = F.when(right, F.when(F.lit(calls > 1), "repaired").when(F.col("removed") > 0, "cleaned")).when(F.col("failed"), "provider").when(output.isNull(), "unreadable")
        why = why.otherwise(F.lit("repair_exhausted" if calls > 1 and calls > repairs else "validation"))
        judged = rows.select(*KEYS, "prompt", output.alias("output"), errors.alias("errors"), over.alias("over"), F.when(right, "done").otherwise("error").alias("status"), why.alias("reason"))
        judged = written(judged)
        ended.append(judged.where("over").select(*KEYS, "status", F.when(F.col("status") == "done", F.col("output")).alias("output"), F.when(F.col("status") == "done", "[]").otherwise(F.col("errors")).alias("errors"), F.lit(calls).alias("calls"), "reason"))
        state = judged.where("not over").select(*KEYS, "prompt", F.when(F.col("output").isNull(), F.col("prompt")).otherwise(repair_request(F.col("errors"), F.col("output"))).alias("request"), "output", "errors")
        if calls > repairs or state.isEmpty():
            break
    return reduce(DataFrame.union, ended)


# Rules of single steps, beside their schemas


def outline_errors(outlines: DataFrame) -> DataFrame:
    """``job, path, rule``: outlines with too few or too many sections for their minutes. ``outlines(job, minutes, sections)``; no minutes allow any number."""
    low, high = section_range(F.col("minutes"))
    return outlines.where((high > 0) & ~F.col("sections").between(low, high)).select("job", F.lit("/sections").alias("path"), F.lit("sections for the minutes").alias("rule"))


def review_errors(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """``job, path, rule``: issues about nodes that aren't there (or about none). ``issues(job, place, node)``, ``nodes(job, id)`` of sections, activities and questions."""
    known = nodes.select(F.col("job").alias("of"), "id")
    lost = issues.join(known, (F.col("job") == F.col("of")) & (F.col("node") == F.col("id")), "left_anti")
    return lost.select("job", F.concat(F.lit("/issues/"), F.col("place").cast("string"), F.lit("/node")).alias("path"), F.lit("broken reference").alias("rule"))


def digest_errors(digests: DataFrame) -> DataFrame:
    """``job, path, rule``: digests without any item. ``digests(job, concepts, definitions, objectives, procedures)``, as numbers; null is none."""
    items = sum((F.coalesce(c, F.lit(0)) for c in ("concepts", "definitions", "objectives", "procedures")), F.lit(0))
    return digests.where(items == 0).select("job", F.lit("").alias("path"), F.lit("empty digest").alias("rule"))


# Sections as they came

PAGE = "struct<id:string,title:string>"
PART = f"struct<type:string,url:string,pages:array<{PAGE}>>"
#: A scheme, a host and no spaces; addresses are ASCII.
ADDRESS = r"\A[A-Za-z][A-Za-z0-9+.-]*://[!-~&&[^/?#]]+[!-~]*\z"


def _numbered(pages: Column) -> Column:
    """Pages without an id get that of their place (p1, p2, ...), unless another page has it already."""
    unset = lambda p: F.coalesce(p["id"], F.lit("")).isin("", "0")
    used = F.transform(F.filter(pages, lambda p: ~unset(p)), lambda p: p["id"])

    def own(p: Column, i: Column) -> Column:
        name = F.concat(F.lit("p"), (i + 1).cast("string"))
        return F.when(unset(p) & ~F.array_contains(used, name), p.withField("id", name)).otherwise(p)

    return F.transform(pages, own)


def normalized_sections(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """``job, node, id, activities, numbered, removed, renamed`` of ``answers(job, node, id, activities)``, activities as ``array<PART>``.

    The id becomes the node's. Pages of lessons without an id get one by their place. Links (``url`` activities) to what is no address or
    occurs in no source text of the job go, unless nothing would be left; a job without ``texts(job, text)`` keeps them all. Null lists stay null.
    """
    link = lambda a: (a["type"] == "url") & a["url"].isNotNull()
    lesson = lambda a: F.coalesce(a["type"] == "lesson", F.lit(False)) & a["pages"].isNotNull()
    urls = answers.select("job", F.explode(F.filter("activities", lambda a: link(a) & a["url"].rlike(ADDRESS))).alias("a")).select("job", F.col("a.url").alias("url")).distinct()
    own = texts.select(F.col("job").alias("of"), "text")
    found = urls.join(own, (F.col("job") == F.col("of")) & F.col("text").contains(F.col("url")), "left_semi")
    found = found.groupBy("job").agg(F.collect_set("url").alias("found"))
    jobs = texts.select("job").distinct().withColumn("sourced", F.lit(True))
    rows = answers.join(jobs, "job", "left").join(found, "job", "left")
    known = F.coalesce("found", F.array().cast("array<string>"))
    kept = F.filter("activities", lambda a: ~F.coalesce(link(a), F.lit(False)) | F.array_contains(known, a["url"]))
    chosen = F.when(F.col("sourced") & (F.size(kept) > 0), kept).otherwise(F.col("activities"))
    rows = rows.select("job", "node", "id", "activities", chosen.alias("chosen"))
    made = F.transform("chosen", lambda a: F.when(lesson(a), a.withField("pages", _numbered(a["pages"]))).otherwise(a))
    without = lambda c: F.aggregate(c, F.lit(0), lambda n, a: n + F.when(lesson(a), F.size(F.filter(a["pages"], lambda p: F.coalesce(p["id"], F.lit("")).isin("", "0")))).otherwise(0))
    rows = rows.select("job", "node", "id", "activities", "chosen", made.alias("made"))
    return rows.select("job", "node", F.col("node").alias("id"), F.col("made").alias("activities"), (without("chosen") - without("made")).alias("numbered"), (F.size("activities") - F.size("chosen")).alias("removed"), (~F.col("id").eqNullSafe(F.col("node"))).alias("renamed"))
