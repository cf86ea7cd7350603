"""Files of documents as rows, and tables written so that a rerun replaces what it wrote before."""

from __future__ import annotations

import codecs
import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import html_to_markdown, tidy
from ..operators.jobs import source_type

TEXTS = "path string, type string, text string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(raw: bytes) -> str:
    """UTF-8 or UTF-16 by their marks, else UTF-8 if it is valid, else Windows-1250."""
    if raw.startswith(codecs.BOM_UTF8):
        return raw[3:].decode("utf-8", "replace")
    if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1250", "replace")


def _heading_levels(styles: bytes | None) -> dict[str, int]:
    """Heading level by style id: a style's own outline level or English name (``heading 2``; ``Title`` is 1), or else that of what it is based on.

    Word in other languages gives built-in styles local ids and keeps their names.
    """
    own, base = {}, {}
    for style in ElementTree.fromstring(styles).iter(f"{WORD}style") if styles else ():
        ident = style.get(f"{WORD}styleId", "")
        get = lambda path: next((e.get(f"{WORD}val", "") for e in style.iterfind(path)), "")  # noqa: B023, E731
        name, outline = get(f"{WORD}name").lower(), get(f"{WORD}pPr/{WORD}outlineLvl")
        base[ident] = get(f"{WORD}basedOn")
        if name == "title":
            own[ident] = 1
        elif name.startswith("heading") and name[7:].strip().isdigit():
            own[ident] = int(name[7:])
        elif outline.isdigit() and int(outline) < 9:
            own[ident] = int(outline) + 1
    out = {}
    for ident in base:
        at, seen = ident, set()
        while at in base and at not in own and at not in seen:
            seen.add(at)
            at = base[at]
        if at in own:
            out[ident] = own[at]
    return out


def _paragraph(p: ElementTree.Element, levels: dict[str, int]) -> tuple[str, str]:
    text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
    style = p.find(f"{WORD}pPr/{WORD}pStyle")
    name = style.get(f"{WORD}val", "") if style is not None else ""
    plain = int(name[7:]) if name.lower().startswith("heading") and name[7:].strip().isdigit() else 0
    heading, depth = levels.get(name, plain), p.find(f"{WORD}pPr/{WORD}numPr/{WORD}ilvl")
    if text and heading:
        return "heading", "#" * min(3, heading) + " " + text
    if text and depth is not None:
        return "list", "  " * int(depth.get(f"{WORD}val", "0")) + "- " + text
    return "text", text


def _table(table: ElementTree.Element) -> str:
    """A Markdown table, its first row as the header; short rows are padded, a cell's paragraphs are one line."""
    texts = lambda cell: " ".join(" ".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in cell.iter(f"{WORD}p")).split()).replace("|", "\\|")
    rows = [[texts(cell) for cell in row.iterfind(f"{WORD}tc")] for row in table.iterfind(f"{WORD}tr")]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*row, *[""] * (width - len(row))]) + " |" for row in rows if any(row)]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def docx_markdown(raw: bytes) -> str:
    """A Word file: headings by style, whatever its language, list items by depth, tables; the rest as it is.

    The body is read as a stream of XML events, block by block. List items in a row stay together. A file that
    is no Word file gives no text.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as parts:
            levels = _heading_levels(parts.read("word/styles.xml") if "word/styles.xml" in parts.namelist() else None)
            blocks, above = [], []
            with parts.open("word/document.xml") as body:
                for event, element in ElementTree.iterparse(body, ("start", "end")):
                    if event == "start":
                        above.append(element.tag)
                        continue
                    above.pop()
                    if element.tag not in (f"{WORD}p", f"{WORD}tbl") or {f"{WORD}tbl", f"{WORD}p"} & set(above):
                        continue  # what a table or a paragraph holds belongs to it
                    blocks.append(_paragraph(element, levels) if element.tag == f"{WORD}p" else ("table", _table(element)))
                    element.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    blocks = [b for b in blocks if b[1]]
    joints = ["\n" if one[0] == two[0] == "list" else "\n\n" for one, two in zip(blocks, blocks[1:], strict=False)]
    return "".join(x for pair in zip([b[1] for b in blocks], [*joints, ""], strict=True) for x in pair)


def decoded_texts(files: DataFrame) -> DataFrame:
    """``files`` with ``text`` in place of ``content`` (bytes), tidied, and ``error``: ``no text`` where nothing is left, also for null content."""
    rest = [f for f in files.schema if f.name != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=["" if raw is None else decoded(bytes(raw)) for raw in batch["content"]]).drop(columns="content")

    made = files.mapInPandas(run, StructType([*rest, StructField("text", StringType())]))
    return made.withColumn("text", tidy(F.col("text"))).withColumn("error", F.when(F.col("text") == "", "no text"))


def read_files(spark: SparkSession, path: str, max_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """``(texts, errors)`` of the files under ``path``: ``path, type, text`` and ``path, error``.

    Text, Markdown, HTML and Word files are read; files of other types, too large ones and files
    without text are errors. Spark lists and reads the files; one file is one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = source_type(F.lit(""), F.col("path"))
    files = files.select("path", "length", "content", kind.alias("type"))
    readable = F.col("type").isin("txt", "md", "html", "docx") & (F.col("length") <= max_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [docx_markdown(raw) if kind == "docx" else decoded(raw) for kind, raw in zip(batch["type"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "type": batch["type"], "text": texts})

    texts = files.where(readable).select("path", "type", "content").mapInPandas(run, TEXTS)
    texts = texts.withColumn("text", F.when(F.col("type") == "html", html_to_markdown(F.col("text"))).otherwise(tidy(F.col("text"))))
    why = F.when(F.col("type").isNull(), "type not allowed").when(F.col("length") > max_bytes, "too large").otherwise("no reader")
    errors = files.where(~F.coalesce(readable, F.lit(False))).select("path", why.alias("error"))
    return texts.where("text <> ''"), errors.union(texts.where("text = ''").select("path", F.lit("no text").alias("error")))


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Write ``rows`` by ``key``; keys that are written replace what was there, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see; only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='docloom-')}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written once under the shared folder and read from there, where several steps need what was costly to make."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], seen: int) -> int:
    """Show new versions of several tables in one step: readers see all of them or none. The number of the version.

    Every table is written to a folder of its own; then one small file, ``versions/<seen + 1>``, which says where they are, is created, or not if it
    is there already: another writer has published since ``seen``, and this one has to begin again from what is there now
    (``FileExistsError``). Tables that aren't given stay those of ``seen``. What an interrupted writer left is never read.
    The file system's rename must be atomic and not replace, as that of HDFS.
    """
    places = dict(published(spark, root, seen)) if seen else {}
    for name, rows in tables.items():
        places[name] = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{root}/{places[name]}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{seen + 1:012d}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/.{uuid.uuid4().hex}")
    out = files.create(own, False)
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    if files.exists(path) or not files.rename(own, path):
        files.delete(own, False)
        raise FileExistsError(f"version {seen + 1} was published by another writer")
    return seen + 1


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version that was published; 0 for none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def published(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    """Where the tables of a version are, under ``root``."""
    text = spark.read.text(f"{root}/versions/{version:012d}", wholetext=True).first()[0]
    return json.loads(text)


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{published(spark, root, version or latest(spark, root))[name]}")


def ingested(chunks: DataFrame, sources: DataFrame, estimates: DataFrame, new_chunks: DataFrame, done: DataFrame, new_estimates: DataFrame) -> dict[str, DataFrame]:
    """What a read source changes, for ``publish``: its chunks replace the old ones, its status and token count follow, its job's estimate is made anew.

    ``chunks(sourceid, ...)``, ``sources(id, status, tokencount, language, ...)``, ``estimates(jobid, cost)``; ``done(id, language)`` are the sources that
    were read, ``new_chunks`` all that they have now (with ``tokencount``). Others stay as they are.
    """
    read = done.select(F.col("id").alias("sourceid")).distinct()
    kept = chunks.join(read, "sourceid", "left_anti").unionByName(new_chunks)
    tokens = new_chunks.groupBy(F.col("sourceid").alias("of")).agg(F.sum("tokencount").alias("tokens"))
    own = done.groupBy(F.col("id").alias("of")).agg(F.max("language").alias("spoken")).join(tokens, "of", "left").withColumn("is_read", F.lit(True))
    rows = sources.join(own, F.col("id") == F.col("of"), "left")
    set_ = {"status": F.lit("extracted"), "tokencount": F.coalesce("tokens", F.lit(0)), "language": F.col("spoken")}
    rows = rows.select(*[F.when(F.col("is_read"), set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else c for c in sources.columns])
    costs = estimates.join(new_estimates, "jobid", "left_anti").unionByName(new_estimates)
    return {"chunks": kept, "sources": rows, "estimates": costs}
