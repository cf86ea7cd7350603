"""Jobs and their sources, steps and versions: lists, visibility, export and deletion, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PAGE_SIZE

#: Types of source files: mimetype, ending, type.
TYPES = (
    ("application/pdf", "pdf", "pdf"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", "docx"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx", "pptx"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", "xlsx"),
    ("text/plain", "txt", "txt"),
    ("text/markdown", "md", "md"),
    ("text/html", "html", "html"),
)


def source_type(mimetype: Column, filename: Column) -> Column:
    """By mimetype, of unknown ones by the name's ending; null if that is unknown too."""
    ending = F.lower(F.regexp_extract(filename, r"\.([^.]*)\z", 1))
    pick = lambda key, i: F.coalesce(*[F.when(key == t[i], t[2]) for t in TYPES])
    return F.coalesce(pick(mimetype, 0), pick(ending, 1))


def admitted(files: DataFrame, held: DataFrame, max_files: int = 10, max_bytes: int = 50 << 20) -> DataFrame:
    """``jobid, files, admitted``: a job's new files are all taken or none: not too many with those it has, each of a known type and size.

    ``files(jobid, filename, mimetype, filesize)``, ``held(jobid)``: one row per file it has.
    """
    ok = source_type(F.col("mimetype"), F.col("filename")).isNotNull() & (F.col("filesize") <= max_bytes)
    new = files.groupBy("jobid").agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("each"))
    old = held.groupBy("jobid").agg(F.count(F.lit(1)).alias("held"))
    rows = new.join(old, "jobid", "left")
    return rows.select("jobid", "files", (F.col("each") & (F.col("files") + F.coalesce("held", F.lit(0)) <= max_files)).alias("admitted"))


def loadable_sources(sources: DataFrame) -> DataFrame:
    """``jobid, place, key, text`` of digested sources that have a text and a digest that is JSON, in order of id."""
    good = (F.col("status") == "digested") & (F.coalesce("text", F.lit("")) != "") & F.try_parse_json("digest").isNotNull()
    place = F.row_number().over(Window.partitionBy("jobid").orderBy("id"))
    return sources.where(good).select("jobid", place.alias("place"), F.concat(F.lit("src"), F.col("id").cast("string")).alias("key"), "text")


def context_of(courseid: Column, categoryid: Column) -> Column:
    return F.when(courseid != 0, F.concat(F.lit("course:"), courseid.cast("string"))).when(categoryid != 0, F.concat(F.lit("category:"), categoryid.cast("string"))).otherwise("system")


def visible(jobs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Jobs whose context is in ``allowed(context)``; null ids are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return jobs.withColumn("context", context_of(zero("courseid"), zero("categoryid"))).join(allowed.select("context").distinct(), "context", "left_semi")


def visible_count(jobs: DataFrame, allowed: DataFrame) -> DataFrame:
    """``n``: jobs are counted per context before they meet the allowed ones."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = jobs.groupBy(context_of(zero("courseid"), zero("categoryid")).alias("context")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(allowed.select("context").distinct(), "context", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def page(jobs: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the list, newest first."""
    return jobs.orderBy(F.desc("timecreated"), F.desc("id")).offset(max(0, number) * size).limit(size)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row of each job's highest version."""
    rest = [c for c in versions.columns if c != "jobid"]
    return versions.groupBy("jobid").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("jobid", "v.*")


def versions_or_latest(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``jobid, version, found``: the wanted version if positive, else the latest; ``found`` is null if there is none. ``wanted(jobid, version)``."""
    exact = versions.select("jobid", "version", F.col("version").alias("found"))
    last = versions.groupBy("jobid").agg(F.max("version").alias("last"))
    return wanted.join(exact, ["jobid", "version"], "left").join(last, "jobid", "left").select("jobid", "version", F.when(F.col("version") > 0, F.col("found")).otherwise(F.col("last")).alias("found"))


def users_with_data(*tables: DataFrame) -> DataFrame:
    """The users of any of the tables, once; each is reduced before they are united."""
    out = tables[0].select("userid").distinct()
    for other in tables[1:]:
        out = out.union(other.select("userid").distinct())
    return out.distinct()


def has_data(users: DataFrame, *tables: DataFrame) -> DataFrame:
    """Those of ``users(userid)`` that occur in any table."""
    return users.join(users_with_data(*tables), "userid", "left_semi")


def export(users: DataFrame, jobs: DataFrame, sources: DataFrame, steps: DataFrame, log: DataFrame, chunks: DataFrame | None = None, versions: DataFrame | None = None, budgets: DataFrame | None = None) -> DataFrame:
    """``userid, document``: what is held about each user, nested, as JSON. Rows gather per job and user; order is by id.

    Jobs hold their ``sources``, ``steps``, ``chunks(jobid, sourceid, chunkindex, tokencount)`` and blueprints (``versions(jobid, version)``); then come the
    ``calls`` and ``budgets(userid, period, spentusd)``. What isn't given is left out.
    """
    own = jobs.join(users.select("userid").distinct(), "userid", "left_semi").withColumnRenamed("id", "jobid")
    keep = own.select("jobid")
    parts = {
        "sources": (sources, ("id", "filename", "status")), "steps": (steps, ("timecreated", "step", "nodekey", "status")),
        "chunks": (chunks, ("sourceid", "chunkindex", "tokencount")), "blueprints": (versions, ("version",)),
    }
    given = {name: part for name, part in parts.items() if part[0] is not None}
    for name, (rows, fields) in given.items():
        lists = rows.join(keep, "jobid", "left_semi").groupBy("jobid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        own = own.join(lists, "jobid", "left")
    out = own.groupBy("userid").agg(F.array_sort(F.collect_list(F.struct("jobid", "prompt", "status", *given))).alias("jobs"))
    rows = users.select("userid").distinct().join(out, "userid", "left")
    more = {"calls": (log, ("id", "step", "model", "status")), "budgets": (budgets, ("period", "spentusd"))}
    also = {name: part for name, part in more.items() if part[0] is not None}
    for name, (table, fields) in also.items():
        lists = table.join(users.select("userid").distinct(), "userid", "left_semi").groupBy("userid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        rows = rows.join(lists, "userid", "left")
    return rows.select("userid", F.to_json(F.struct("jobs", *also)).alias("document"))


def without_users(users: DataFrame, jobs: DataFrame, log: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the users' rows: ``job``, ``log``, and ``children`` (with ``jobid``) of their jobs. Write each over its table."""
    gone = users.select("userid").distinct()
    dead = jobs.join(gone, "userid", "left_semi").select(F.col("id").alias("jobid"))
    kept = {name: rows.join(dead, "jobid", "left_anti") for name, rows in children.items()}
    return kept | {"job": jobs.join(gone, "userid", "left_anti"), "log": log.join(gone, "userid", "left_anti")}


def status_rows(jobs: DataFrame, versions: DataFrame, steps: DataFrame) -> DataFrame:
    """``jobid, status, version, steps, failed``: what a client polls."""
    last = versions.groupBy("jobid").agg(F.max("version").alias("version"))
    made = steps.groupBy("jobid").agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))
    rows = jobs.select(F.col("id").alias("jobid"), "status").join(last, "jobid", "left").join(made, "jobid", "left")
    return rows.fillna(0, ["version", "steps", "failed"])


# Checkpoints


def input_hash(fields: dict[str, Column], input_map: Column) -> Column:
    """sha256 of a step's identity and its input; keys are sorted, lists keep their order."""
    keys = F.map_from_entries(F.array_sort(F.map_entries(input_map)))
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)], keys.alias("zinput"))), 256)


def reusable(steps: DataFrame) -> DataFrame:
    """``jobid, inputhash``: steps whose result can be taken again: done or made by hand, with an output that isn't empty."""
    ok = F.col("status").isin("done", "manual") & F.col("output").isNotNull() & ~F.col("output").isin("", "[]", "{}", "null")
    return steps.where(ok).select("jobid", "inputhash").distinct()


def pending(wanted: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps (``jobid, inputhash`` and more) that have to be run."""
    return wanted.join(reusable(steps), ["jobid", "inputhash"], "left_anti")


def attempts(steps: DataFrame) -> DataFrame:
    """``jobid, inputhash, attempts``: starts of a step so far."""
    return steps.groupBy("jobid", "inputhash").agg(F.count(F.lit(1)).alias("attempts"))


def started(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """``jobid, inputhash, status, attempts``: the rows that starting steps leave: a new one with one attempt, or what was there with one more, running.

    ``steps(jobid, inputhash, status, attempts)``; ``starts(jobid, inputhash)``, a row for each start. Steps that nobody starts stay as they are.
    """
    key = ["jobid", "inputhash"]
    more = starts.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("more"))
    rows = steps.groupBy(*key).agg(F.max_by("status", "attempts").alias("status"), F.max("attempts").alias("attempts")).join(more, key, "full")
    return rows.select(*key, F.when(F.col("more").isNotNull(), "running").otherwise(F.col("status")).alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("int").alias("attempts"))


def finished_status(success: Column, manual: Column) -> Column:
    return F.when(success & manual, "manual").when(success, "done").otherwise("error")


def saved_versions(saves: DataFrame) -> DataFrame:
    """``jobid, seq, version, is_new``: a save whose content equals the one before is not a new version. ``saves(jobid, seq, hash)``."""
    order = Window.partitionBy("jobid").orderBy("seq")
    new = (~F.coalesce(F.col("hash") == F.lag("hash").over(order), F.lit(False))).cast("int")
    rows = saves.withColumn("new", new)
    return rows.select("jobid", "seq", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("version"), (F.col("new") == 1).alias("is_new"))


def save_outcomes(saves: DataFrame, latest: DataFrame) -> DataFrame:
    """``jobid, outcome``: a save over a base that is no longer the latest is refused, an equal one changes nothing, and only the latest without errors can be approved.

    ``saves(jobid, base, hash, approve, errors)``, ``latest(jobid, version, hash, status)``.
    """
    rows = saves.join(latest.select("jobid", F.col("version").alias("at"), F.col("hash").alias("now"), F.col("status").alias("state")), "jobid", "left")
    same = F.col("hash") == F.col("now")
    outcome = (
        F.when(F.col("at").isNull(), "missing")
        .when(F.col("base") != F.col("at"), "stale")
        .when(F.col("approve") & same & (F.col("errors") == 0) & (F.col("state") == "draft"), "approved")
        .when(F.col("approve"), "not approved")
        .when(same & (F.col("state") == "draft"), "unchanged")
        .otherwise("saved")
    )
    return rows.select("jobid", outcome.alias("outcome"))
