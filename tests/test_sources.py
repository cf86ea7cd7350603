import zipfile

import pytest

from docloom.operators.usage import sums
from docloom.plans.money import ledger_events
from docloom.sources.files import decoded, latest, publish, read_files, read_published, replace_partitions
from docloom.sources.tables import table
from docloom.streaming import calls
from docloom.streaming import usage as stream


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿șir de text".encode())
    (tmp_path / "b.txt").write_bytes("ţară".encode("cp1250"))
    (tmp_path / "c.html").write_text("<h2>Head</h2><p>Body</p>")
    (tmp_path / "d.md").write_text("  \n")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>Item</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    texts, errors = read_files(spark, str(tmp_path))
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r["path"]): r["text"] for r in texts.collect()} == {"a.txt": "șir de text", "b.txt": "ţară", "c.html": "## Head\n\nBody", "g.docx": "## Title\n\n  - Item"}
    assert {name(r["path"]): r["error"] for r in errors.collect()} == {"d.md": "no text", "e.exe": "type not allowed", "f.pdf": "no reader"}
    assert decoded("x".encode("utf-16")) == "x"


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    replace_partitions(rows((1, "a"), (2, "b")), path, "id")
    replace_partitions(rows((2, "c")), path, "id")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def log(events):
    return events.selectExpr("ts", "user_id as userid", "cast(value as decimal(12,6)) as cost", "1 as tokensin", "1 as tokensout", "1 as tokenscached", "if(event_type = 'error', 'error', 'success') as status")


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_stream_gives_the_batch_sums(spark, sf, tmp_path):
    events = stream.read_events(spark, sf, table(spark, sf, "events").schema)
    made = stream.usage_by_window(log(events)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "w"))
    drained(made.start())
    batch = log(table(spark, sf, "events")).agg(*sums()).first()
    got = spark.sql("select sum(cost) as cost, sum(calls) as calls, sum(errors) as errors from windows").first()
    assert (got["cost"], got["calls"], got["errors"]) == (batch["cost"], batch["calls"], batch["errors"])


def test_stream_of_sessions(spark, sf, tmp_path):
    events = stream.read_events(spark, sf, table(spark, sf, "events").schema)
    drained(stream.sessions(log(events)).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).start())
    assert spark.sql("select sum(calls) from sessions").first()[0] == table(spark, sf, "events").count()


def test_stream_of_reservations_equals_the_batch(spark, sf, tmp_path):
    from docloom.operators.budget import reservations

    events = ledger_events(spark, sf)
    events.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drained(stream.reservations(read, 3_000_000).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "l")).start())
    assert sorted(map(tuple, spark.table("ledger").collect())) == sorted(map(tuple, reservations(events, 3_000_000).collect()))


def test_unknown_month_is_refused(spark, sf):
    from docloom.operators.usage import totals
    from docloom.sources.tables import relation

    with pytest.raises(ValueError, match="2024-13"):
        totals(relation(spark, sf, "call_log"), "2024-13")


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    state = lambda: {name: sorted(r["n"] for r in read_published(spark, root, name).collect()) for name in ("chunks", "sources")}
    assert latest(spark, root) == 0
    assert publish(spark, root, {"chunks": numbers(1, 2), "sources": numbers(1)}, 0) == 1
    broken = spark.range(1).selectExpr("cast(raise_error('lost') as int) as n")
    with pytest.raises(Exception, match="lost"):  # the chunks are written when the sources fail
        publish(spark, root, {"chunks": numbers(3), "sources": broken}, 1)
    assert state() == {"chunks": [1, 2], "sources": [1]} and latest(spark, root) == 1
    assert publish(spark, root, {"sources": numbers(4)}, 1) == 2
    assert state() == {"chunks": [1, 2], "sources": [4]}
    with pytest.raises(FileExistsError):  # it has seen version 1 only
        publish(spark, root, {"chunks": numbers(9)}, 1)
    assert state() == {"chunks": [1, 2], "sources": [4]} and latest(spark, root) == 2


def test_call_log_has_every_attempt_once(spark, tmp_path):
    """The last batch is run again as after a failure before its commit; attempts are sent again in later batches."""
    billed = "struct<connector:string,model:string,tokensin:long,tokensout:long,tokenscached:long,cost:decimal(12,6)>"
    kind = f"call long, attempt int, ts timestamp, userid long, jobid long, step string, connector string, billed {billed}, durationms long, error boolean, httpstatus int"
    source, folder = tmp_path / "in", f"file://{tmp_path}/log"

    def add(*rows):
        made = spark.createDataFrame(rows, "call long, attempt int, userid long, tokens long, error boolean, httpstatus int")
        bill = f"case when tokens is not null then cast(named_struct('connector', 'c', 'model', 'm', 'tokensin', tokens, 'tokensout', 0L, 'tokenscached', 0L, 'cost', 0.5) as {billed}) end as billed"
        made.selectExpr("call", "attempt", "timestamp'2024-01-01 10:00:00' as ts", "userid", "1L as jobid", "'outline' as step", "'set' as connector", bill, "5L as durationms", "error", "httpstatus").coalesce(1).write.mode("append").parquet(str(source))

    read = lambda: calls.append(spark.readStream.schema(kind).parquet(str(source)), folder)
    key = lambda df: sorted((r["call"], r["attempt"], r["status"], r["connector"], r["tokensin"], float(r["cost"]), r["httpstatus"]) for r in df.collect())
    add((1, 1, 7, None, True, 503), (1, 2, 7, 40, False, 0), (1, 2, 7, 40, False, 0), (2, 1, 7, 90, True, 0), (3, 1, None, 1, False, 0))
    want = [(1, 1, "error", "set", 0, 0.0, 503), (1, 2, "success", "c", 40, 0.5, None), (2, 1, "error", "c", 90, 0.5, None)]
    assert key(read()) == want
    commits = sorted((tmp_path / "log/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for old in commits[-1:]:
        old.unlink()
        old.with_name(f".{old.name}.crc").unlink(missing_ok=True)
    assert key(read()) == want
    add((1, 2, 7, 40, False, 0), (4, 1, 8, 3, False, 0))
    assert key(read()) == [*want, (4, 1, "success", "c", 3, 0.5, None)]


def word_file(path, body, styles=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")


def test_word_tables_lists_and_local_styles(spark, tmp_path):
    p = lambda text, style="", depth=None: "<w:p><w:pPr>" + (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{depth}"/></w:numPr>' if depth is not None else "") + f"</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda *ps: "<w:tc>" + "".join(map(p, ps)) + "</w:tc>"
    row = lambda *cells: "<w:tr>" + "".join(cells) + "</w:tr>"
    style = lambda ident, name, more="": f'<w:style w:styleId="{ident}"><w:name w:val="{name}"/>{more}</w:style>'
    styles = style("Titlu", "Title") + style("Titlu1", "heading 1") + style("Titlu2", "heading 2") + style("Meu", "Capitol mic", '<w:basedOn w:val="Titlu2"/>') + style("A", "a", '<w:basedOn w:val="B"/>') + style("B", "b", '<w:basedOn w:val="A"/>') + style("Nivel", "nivel", '<w:pPr><w:outlineLvl w:val="2"/></w:pPr>')
    table = "<w:tbl>" + row(cell("Nume", ""), cell("a|b")) + row(cell("unu", "doi")) + row(cell(""), cell("")) + row(cell("<w:br/>"), cell("x")) + "</w:tbl>"
    body = p("Carte", "Titlu") + p("Partea", "Titlu1") + p("unu", depth=0) + p("doi", depth=1) + p("trei", depth=0) + p("text", "A") + table + p("Mic", "Meu") + p("Al treilea", "Nivel") + p("")
    word_file(tmp_path / "a.docx", body, styles)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    texts, errors = read_files(spark, str(tmp_path))
    want = "# Carte\n\n# Partea\n\n- unu\n  - doi\n- trei\n\ntext\n\n| Nume | a\\|b |\n| --- | --- |\n| unu doi | |\n| | x |\n\n## Mic\n\n### Al treilea"
    assert [r["text"].replace("|  |", "| |") for r in texts.collect()] == [want]
    assert [(r["path"].rsplit("/", 1)[1], r["error"]) for r in errors.collect()] == [("b.docx", "no text")]
