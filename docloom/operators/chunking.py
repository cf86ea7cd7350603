"""Chunks of normalised text, windows of chunks, and digests of windows.

Units (headings and blocks) are array expressions in the document's row. Packing carries
headings back and merges the tail, so it is a fold over one document's units: a small
function over rows that stay where they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CHARS_PER_TOKEN, DIGEST_LIMITS, DIGEST_WINDOW, MAX_TOKENS, MIN_TOKENS, OVERLAP, TITLE, UNIT_LIMIT
from ..functions import text as T
from .structure import pages

CAPITALS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Lu")
SENTENCE = re.compile(rf"(?<=[.!?…])\s+(?=[{CAPITALS}0-9\"„«(])")
CHUNKS = "doc_id long, chunkindex int, title string, pagefrom int, pageto int, content string, tokencount long"


def units(text: Column) -> Column:
    """``array<struct<heading, level, title, text, page>>``: heading lines and the blocks between blank lines, page markers left out."""
    apart = lambda lines: F.regexp_replace(F.array_join(lines, "\n"), r"(?m)^[ \t]*(#{1,6}\s+\S.*?)[ \t]*$", "\n\n$1\n\n")
    block = lambda b, page: F.struct(b.rlike(r"\A#{1,6}\s+\S.*\z").alias("heading"), F.char_length(F.regexp_extract(b, r"\A(#{1,3})", 1)).alias("level"), F.nullif(F.regexp_extract(b, r"\A#{1,6}\s+(\S.*)\z", 1), F.lit("")).alias("title"), b.alias("text"), page.alias("page"))
    ends = lambda b: T.strip(F.regexp_replace(b, r"(?m)[ \t]+$", ""))
    of_page = lambda p: F.transform(F.filter(F.transform(F.split(apart(p["lines"]), r"\n[ \t]*\n\s*", -1), ends), lambda b: b != ""), lambda b: block(b, p["number"]))
    return F.flatten(F.transform(pages(text), of_page))


def count(text: str, chars: float = CHARS_PER_TOKEN) -> int:
    return math.ceil(len(text) / chars)


def split_line(line: str, limit: int) -> list[str]:
    """A line in pieces of at most ``limit`` tokens: sentences, of long ones groups of words, of long words parts."""
    if count(line) <= limit:
        return [line]
    most, out = max(1, int(limit * CHARS_PER_TOKEN)), []
    for sentence in SENTENCE.split(line):
        if count(sentence) <= limit:
            out.append(sentence)
            continue
        group: list[str] = []
        size = 0
        for word in sentence.split():
            for part in (word[i : i + most] for i in range(0, len(word), most)):
                if group and size + 1 + len(part) > most:
                    out.append(" ".join(group))
                    group, size = [], 0
                size += len(part) + bool(group)
                group.append(part)
        if group:
            out.append(" ".join(group))
    return out


def split_block(text: str, limit: int = UNIT_LIMIT) -> list[str]:
    """A block in parts of at most ``limit`` tokens; each part of a table repeats its two first lines."""
    if count(text) <= limit:
        return [text]
    rows = text.split("\n")
    header = rows[:2] if len(rows) > 1 and rows[0].startswith("|") and rows[1].startswith("|") else []
    room = limit - count("\n".join(header))
    parts: list[list[str]] = []
    size = 0
    for row in rows[len(header) :]:
        for i, piece in enumerate(split_line(row, room)):
            gap = "" if not parts else "\n" if i == 0 else " "
            if parts and math.ceil((size + len(gap) + len(piece)) / CHARS_PER_TOKEN) <= room:
                parts[-1] += [gap, piece]
                size += len(gap) + len(piece)
            else:
                parts.append([piece])
                size = len(piece)
    return ["\n".join([*header, "".join(p)]) for p in parts]


class Chunk:
    """Units that go together; ``overlaps`` if a cut by size opened it."""

    def __init__(self, title: str | None = None, overlaps: bool = False, held: list[dict] | None = None):
        self.title, self.overlaps, self.units = title, overlaps, held or []

    @property
    def tokens(self) -> int:
        return sum(u["tokens"] for u in self.units)


def pack(every: list[dict], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[Chunk]:
    """Chunks of ``least`` to ``most`` tokens, cut before headings of the first two levels where they can be."""
    done: list[Chunk] = []
    now, size, title = Chunk(), 0, None
    for u in every:
        if u["heading"]:
            title = u["title"]
            if u["level"] <= 2 and size >= least:
                done.append(now)
                now, size = Chunk(title), 0
        if now.units and size + u["tokens"] > most:
            keep = len(now.units)
            while keep > 1 and now.units[keep - 1]["heading"]:
                keep -= 1
            carried = now.units[keep:]  # headings that end a chunk open the next, with what they introduce
            del now.units[keep:]
            done.append(now)
            now = Chunk(carried[0]["title"] if carried else title, True, carried)
            size = now.tokens
        if not now.units and u["heading"]:
            now.title = u["title"]
        now.units.append(u)
        size += u["tokens"]
    if now.units:
        done.append(now)
    if len(done) > 1 and done[-1].tokens < least and done[-2].tokens + done[-1].tokens <= most:
        tail = done.pop()
        done[-1].units += tail.units
    return done


def overlap(chunk: Chunk, share: float = OVERLAP) -> str:
    """The end of a chunk, at most ``share`` of its tokens: whole units, then whole sentences of one more; nothing before a heading or of a table."""
    room, taken = math.ceil(share * chunk.tokens), []
    for u in reversed(chunk.units):
        if u["heading"]:
            break
        if u["tokens"] <= room:
            taken.append(u["text"])
            room -= u["tokens"]
            continue
        if not u["text"].startswith("|"):
            part = ""
            for sentence in reversed([s for line in u["text"].split("\n") for s in SENTENCE.split(line)]):
                if count(f"{part} {sentence}") > room:
                    break
                part = f"{sentence} {part}" if part else sentence
            if part:
                taken.append(part)
        break
    return "\n\n".join(reversed(taken))


def chunked(doc_id: int, every: list[dict]) -> Iterator[tuple]:
    sized = [{**u, "tokens": count(u["text"])} for u in every]
    parts = [u if u["tokens"] <= UNIT_LIMIT else {"heading": False, "level": 0, "title": None, "text": t, "page": u["page"], "tokens": count(t)} for u in sized for t in (split_block(u["text"]) if u["tokens"] > UNIT_LIMIT else [u["text"]])]
    before = None
    for i, c in enumerate(pack(parts)):
        own = "\n\n".join(u["text"] for u in c.units)
        head = overlap(before) if before and c.overlaps else ""
        content = f"{head}\n\n{own}" if head else own
        numbers = [int(u["page"]) for u in c.units if u["page"] is not None and u["page"] == u["page"]]
        yield doc_id, i, c.title and c.title[:TITLE], min(numbers, default=None), max(numbers, default=None), content, count(content)
        before = c


def chunks(documents: DataFrame) -> DataFrame:
    """The chunks of ``documents(doc_id, text)``, whose texts are normalised; a document without text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for doc, us in zip(batch["doc_id"], batch["units"], strict=True) if us is not None for r in chunked(doc, [dict(u) if isinstance(u, dict) else u.asDict() for u in us])]
            yield pd.DataFrame(rows, columns=["doc_id", "chunkindex", "title", "pagefrom", "pageto", "content", "tokencount"]).astype({"pagefrom": "Int32", "pageto": "Int32"})

    return documents.select("doc_id", units(F.col("text")).alias("units")).mapInPandas(run, CHUNKS)


def with_hashes(made: DataFrame) -> DataFrame:
    return made.withColumn("contenthash", F.sha1("content"))


def source_totals(made: DataFrame) -> DataFrame:
    """``doc_id, chunks, tokencount``: overlaps count again."""
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokencount").alias("tokencount"))


def windows(made: DataFrame, limit: int = DIGEST_WINDOW) -> DataFrame:
    """``doc_id, chunkindex, window``: consecutive chunks of at most ``limit`` tokens together; a larger one is alone.

    The sum starts anew at each cut, so it is a fold over one document's token counts.
    """
    rows = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunkindex", "tokencount"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("window"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        cut = (F.size(acc["out"]) > 0) & (acc["sum"] + c["tokencount"] > limit)
        window = acc["window"] + cut.cast("int")
        return F.struct((F.when(cut, 0).otherwise(acc["sum"]) + c["tokencount"]).cast("long").alias("sum"), window.alias("window"), F.concat(acc["out"], F.array(window)).alias("out"))

    folded = rows.select("doc_id", "c", F.aggregate("c", start, step, lambda acc: acc["out"]).alias("w"))
    return folded.select("doc_id", F.explode(F.arrays_zip(F.col("c.chunkindex").alias("chunkindex"), F.col("w").alias("window"))).alias("x")).select("doc_id", "x.chunkindex", "x.window")


def rendered_windows(made: DataFrame, placed: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, window, text``: the prompt text of each window. ``names(doc_id, filename)``."""
    number = F.when(F.col("pagefrom") == F.col("pageto"), F.col("pagefrom").cast("string")).otherwise(F.concat(F.col("pagefrom").cast("string"), F.lit("-"), F.col("pageto").cast("string")))
    span = F.when(F.col("pagefrom").isNotNull(), F.concat(F.lit(" | pages "), number)).otherwise("")
    title = F.coalesce(F.concat(F.lit(" | title: "), "title"), F.lit(""))
    piece = F.concat(F.lit("\n<<< chunk "), F.col("chunkindex").cast("string"), span, title, F.lit(" >>>\n"), "content", F.lit("\n"))
    rows = made.join(placed, ["doc_id", "chunkindex"]).groupBy("doc_id", "window").agg(F.array_sort(F.collect_list(F.struct("chunkindex", piece.alias("piece")))).alias("p"))
    return rows.join(names, "doc_id").select("doc_id", "window", F.concat(F.lit("Document: "), "filename", F.lit("\n"), F.array_join("p.piece", "")).alias("text"))


def rebuilt(made: DataFrame, sources: DataFrame) -> DataFrame:
    """``jobid, doc_id, chunkindex, start, piece``: the text of a job's sources, as pieces with the character each starts at; overlaps repeat.

    The pieces of a job, in order of ``start``, are its whole text: every chunk after a line break. Where a source starts comes from the sums of those before it,
    where a chunk starts from those of its source, so no value is larger than a chunk. ``sources(doc_id, jobid)``.
    """
    rows = made.join(sources, "doc_id").withColumn("piece", F.concat(F.lit("\n"), "content"))
    size = F.char_length("piece").cast("long")
    first = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("jobid", "doc_id").agg(F.sum(size).alias("size"))
    starts = sizes.select("jobid", "doc_id", F.coalesce(F.sum("size").over(first(["jobid"], "doc_id")), F.lit(0)).alias("doc_start"))
    own = rows.withColumn("own", F.coalesce(F.sum(size).over(first(["jobid", "doc_id"], "chunkindex")), F.lit(0)))
    return own.join(starts, ["jobid", "doc_id"]).select("jobid", "doc_id", "chunkindex", (F.col("doc_start") + F.col("own")).alias("start"), "piece")


# Digests: window answers as rows (source, window, list, pos, name, detail, refs)


def cleaned_items(items: DataFrame, known: DataFrame, limits: dict[str, int] = DIGEST_LIMITS) -> DataFrame:
    """Items with a name, blanks collapsed, the first so many of each list; ``refs`` whole, of the window and once each.

    ``items(source, window, list, pos, name, detail, refs array<string>)``; definitions and procedures need
    a detail. ``known(source, window, indexes array<int>)``.
    """
    plain = lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{A0}]+", " "))
    rows = items.withColumns({"name": plain(F.col("name")), "detail": plain(F.col("detail"))}).where((F.col("name") != "") & (~F.col("list").isin("definitions", "procedures") | (F.col("detail") != "")))
    nth = F.row_number().over(Window.partitionBy("source", "window", "list").orderBy("pos"))
    limit = F.when(F.lit(False), 0)
    for name, most in limits.items():
        limit = limit.when(F.col("list") == name, most)
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= limit.otherwise(0)).join(known, ["source", "window"])
    whole = F.transform(F.filter("refs", lambda r: r.rlike(r"\A[0-9]+\z")), lambda r: r.cast("int"))
    refs = F.array_distinct(F.filter(whole, lambda r: F.array_contains("indexes", r)))
    return rows.select("source", "window", "list", "pos", "name", "detail", refs.alias("refs"))


def empty_windows(known: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The windows whose answer has no item: errors."""
    return known.select("source", "window").join(cleaned.select("source", "window").distinct(), ["source", "window"], "left_anti")


def merged_items(cleaned: DataFrame) -> DataFrame:
    """``source, list, place, name, detail, refs``: an item once, as first named, with the refs of all its windows in order."""
    key = F.lower("name").alias("key")
    rows = cleaned.groupBy("source", "list", key).agg(F.array_sort(F.collect_list(F.struct("window", "pos", "name", "detail", "refs"))).alias("all"))
    first = F.get("all", F.lit(0))
    rows = rows.select("source", "list", first["window"].alias("w"), first["pos"].alias("p"), first["name"].alias("name"), first["detail"].alias("detail"), F.array_distinct(F.flatten("all.refs")).alias("refs"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "list").orderBy("w", "p"))).drop("w", "p")


def envelopes(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, title, language``: the first window's that has one; else the file name's stem and the source's language.

    ``answers(source, window, title, language)``, ``sources(source, filename, language)``; a language is two or three letters.
    """
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("window")))
    got = answers.groupBy("source").agg(first("title").alias("got_title"), first("language").alias("got_language"))
    rows = sources.join(got, "source", "left")
    known = F.col("got_language").rlike(r"\A[a-z]{2,3}\z")
    return rows.select("source", F.coalesce("got_title", F.regexp_replace("filename", r"\.[^.]*\z", "")).alias("title"), F.when(known, F.col("got_language")).otherwise(F.col("language")).alias("language"))


def digest_language(source: Column, job: Column, default: str = "ro") -> Column:
    """The source's language if it has two letters, else the job's first two, else the default."""
    return F.when(source.rlike(r"\A[a-z]{2}\z"), source).when(F.substring(F.coalesce(job, F.lit("")), 1, 2).rlike(r"\A[a-z]{2}\z"), F.substring(job, 1, 2)).otherwise(default)


def referenced_chunks(sections: DataFrame, made: DataFrame) -> DataFrame:
    """``section, source, chunkindex, content`` of the chunks that sections cite. ``sections(section, refs array<string>)``, a ref is ``src12`` (its chunk 0) or ``src12#3``."""
    refs = sections.select("section", F.explode("refs").alias("ref"))
    number = F.regexp_extract("ref", r"\Asrc([0-9]+)(?:#([0-9]+))?\z", 1)
    at = F.regexp_extract("ref", r"\Asrc([0-9]+)(?:#([0-9]+))?\z", 2)
    cited = refs.where(number != "").select("section", number.cast("long").alias("doc_id"), F.when(at == "", 0).otherwise(at.try_cast("int")).alias("chunkindex")).distinct()
    return cited.join(made.select("doc_id", "chunkindex", "content"), ["doc_id", "chunkindex"]).select("section", F.col("doc_id").alias("source"), "chunkindex", "content")
