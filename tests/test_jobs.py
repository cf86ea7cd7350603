import json

from pyspark.sql import functions as F

from docloom.operators import generation as G
from docloom.operators import jobs as J
from docloom.operators import schema
from docloom.sources.tables import relation, table


def test_export_holds_what_a_user_has(spark, sf):
    read = lambda name: relation(spark, sf, name)
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("userid")).where("userid in (3, 5)")
    rows = {r["userid"]: json.loads(r["document"]) for r in J.export(users, read("job"), read("source"), read("step"), read("call_log")).collect()}
    jobs = {r["id"] for r in read("job").where("userid = 3").collect()}
    assert {j["jobid"] for j in rows[3]["jobs"]} == jobs
    assert len(rows[5]["calls"]) == read("call_log").where("userid = 5").count()


NUMBER = {"type": "object", "additionalProperties": False, "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 5}}}


def test_answers_in_rounds(spark, tmp_path):
    """Each kind of answer takes its way: how often it is asked for, with what, and how it ends; calls are counted where they are made."""
    log = tmp_path / "calls"
    log.mkdir()

    def provider(request):
        import os
        import uuid

        name = request.split("|")[1] if "|" in request else "repair"
        if "Errors: " in request:
            name = "repair " + json.loads(request.split("Document: ")[1])["w"]
        (log / f"{name}-{uuid.uuid4()}").write_text(request)
        n = len([f for f in os.listdir(log) if f.startswith(name + "-")])
        return {
            "good": '{"n": 7}', "extra": '{"n": 7, "x": 1}', "words": "no" if n < 3 else '{"n": 9}', "never": "no", "lost": 1 // 0 if name == "lost" else "",
            "fix": '{"n": 1, "w": "fix"}', "repair fix": '{"n": 8}', "twice": '{"n": 1, "w": "twice"}', "repair twice": '{"n": 2, "w": "twice"}' if n < 2 else '{"n": 6}',
            "stuck": '{"n": 1, "w": "stuck"}', "repair stuck": '{"n": 1, "w": "stuck"}', "mute": '{"n": 1, "w": "mute"}', "repair mute": "sorry", "gone": '{"n": 1, "w": "gone"}', "repair gone": 1 // 0 if name == "repair gone" else "",
        }[name]

    want = {
        "good": ("done", 7, 1, None), "extra": ("done", 7, 1, "cleaned"), "words": ("done", 9, 3, "repaired"), "never": ("error", None, 3, "unreadable"), "lost": ("error", None, 1, "provider"),
        "fix": ("done", 8, 2, "repaired"), "twice": ("done", 6, 3, "repaired"), "stuck": ("error", None, 3, "repair_exhausted"), "mute": ("error", None, 2, "validation"), "gone": ("error", None, 2, "provider"),
    }
    wanted = spark.createDataFrame([(1, k, f"say |{k}|") for k in want] + [(1, "old", "say |never|"), (1, "good", "say |good|")], "jobid long, inputhash string, prompt string")
    steps = spark.createDataFrame([(1, "old", "done", '{"x": 1}'), (2, "good", "done", '{"x": 1}')], "jobid long, inputhash string, status string, output string")
    made = G.answers(wanted, steps, provider, lambda v: schema.stripped(v, NUMBER))
    paid = len(list(log.iterdir()))
    rows = {r["inputhash"]: r for r in made.collect()}
    assert {k: (r["status"], r["output"] and json.loads(r["output"])["n"], r["calls"], r["reason"]) for k, r in rows.items()} == want
    assert paid == sum(w[2] for w in want.values())
    made.count()
    assert len(list(log.iterdir())) == paid  # reading the result again pays for nothing
    assert [e["keyword"] for e in json.loads(rows["stuck"]["errors"])] == ["additionalProperties", "minimum"]
    asked = next(log.glob("repair twice-*")).read_text()
    assert '"keyword":"minimum"' in asked and asked.endswith('"w":"twice"}')


def test_repaired_json(spark):
    broken = ['```json\n{"a": [1, 2,],}\n```', 'x {"a": "say \\"} // no", "b": None} y', '{"a": {"b": [1, {"c": "half', '{"t": True, /* c */ "f": False, "n": NaN}', '{"a": 1']
    df = spark.createDataFrame([(b,) for b in broken], "t string")
    got = [json.loads(r[0]) for r in df.select(G.repaired_json(G.json_block(F.col("t")))).collect()]
    assert got == [{"a": [1, 2]}, {"a": 'say "} // no', "b": None}, {"a": {"b": [1, {"c": "half"}]}}, {"t": True, "f": False, "n": 0}, {"a": 1}]


def test_json_out_of_answers(spark):
    import json

    from pyspark.sql import functions as F

    from docloom.operators import generation as G

    cases = [
        ('So: {"a": 1} as in {b}', {"a": 1}),
        ("{'a': 'x \"y\" it\\'s', 'b': [True, None]}", {"a": 'x "y" it\'s', "b": [True, None]}),
        ('{"a": "True, it\'s // no comment", /* one */ "b": [1, 2,], // two\n}', {"a": "True, it's // no comment", "b": [1, 2]}),
        ('```json\n{"a": "}"}\n``` and more', {"a": "}"}),
        ('{"a": ["}", {"b": "cut', {"a": ["}", {"b": "cut"}]}),
        ('see [1]: [{"a": "\\"}"}] }', {"a": '"}'}),
        ('```\n[1]\n``` {"a": 2}', {"a": 2}),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", G.repaired_json(G.json_block(F.col("t"))).alias("x")).collect()
    for r in got:
        assert json.loads(r["x"]) == cases[r["i"]][1], r
    long = spark.createDataFrame([("[" + '"True", True, ' * 40_000 + "0]",)], "t string").select(G.repaired_json("t").alias("x")).first()[0]
    assert json.loads(long)[:2] == ["True", True]


def test_sections_as_they_came(spark):
    page = lambda *ids: {"type": "lesson", "pages": [{"id": i, "title": "t"} for i in ids]}
    url = lambda u: {"type": "url", "url": u}
    good, bad = url("https://x.org/a"), url("https://x.org/b")
    cases = [
        (1, [page(None, "p1", "", "x")], 1, 0, [["", "p1", "p3", "x"]]),  # p1 is taken, so the first stays without
        (1, [page("p2", None, "0")], 1, 0, [["p2", "", "p3"]]),
        (1, [good, bad, url("no address"), page("a")], 0, 2, [["a"]]),
        (1, [bad, url("ftp://")], 0, 0, []),  # all would go
        (2, [bad], 0, 0, []),  # no sources
        (1, [url(None), {"type": None, "url": "z"}, good], 0, 0, []),
        (1, None, 0, 0, None),
    ]
    rows = spark.createDataFrame([(job, f"s{n}", None if n % 2 else f"s{n}", json.dumps(a)) for n, (job, a, *_) in enumerate(cases)], "job int, node string, id string, j string")
    answers = rows.selectExpr("job", "node", "id", f"from_json(j, 'array<{G.PART}>') as activities")
    texts = spark.createDataFrame([(1, "see https://x.org/a or no address"), (3, "https://x.org/b")], "job int, text string")
    for r in G.normalized_sections(answers, texts).collect():
        n = int(r["node"][1:])
        _, before, numbered, removed, pages = cases[n]
        assert r["id"] == r["node"] and r["renamed"] == bool(n % 2)
        if before is None:
            assert r["activities"] is None
            continue
        assert (r["numbered"], r["removed"], len(r["activities"])) == (numbered, removed, len(before) - removed), n
        assert [[p["id"] or "" for p in a["pages"]] for a in r["activities"] if a["type"] == "lesson"] == pages
