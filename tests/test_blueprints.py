import json

from docloom.operators import blueprints as B


def blueprint(spark, sections):
    return spark.createDataFrame([(1, json.dumps(sections))], "bp long, j string").selectExpr("bp", f"from_json(j, 'array<{B.SECTION}>') as sections")


def test_shape_errors(spark):
    ok = {"id": "s1.page1", "type": "page", "title": "P", "questions": [{"id": "q1", "qtype": "multichoice", "answers": [{"fraction": 1}]}]}
    bad = {"id": "s1.x", "type": "poem", "title": "", "questions": [{"id": "1", "qtype": "riddle", "answers": []}, {"qtype": "truefalse", "answers": []}]}
    rows = B.shape_errors(blueprint(spark, [{"id": "s1", "title": "T", "activities": [ok, bad], "subsections": [{"id": "s1.1", "activities": [ok]}]}, {"id": "t", "title": "T", "activities": [], "subsections": []}])).collect()
    assert {(r["path"], r["keyword"]) for r in rows} == {
        ("/sections/0/activities/1/id", "pattern"), ("/sections/0/activities/1/type", "enum"), ("/sections/0/activities/1/title", "minLength"),
        ("/sections/0/activities/1/questions/0/id", "pattern"), ("/sections/0/activities/1/questions/0/qtype", "enum"),
        ("/sections/0/activities/1/questions/1/id", "required"), ("/sections/0/activities/1/questions/1/answers", "minItems"),
        ("/sections/0/subsections/0/id", "pattern"), ("/sections/0/subsections/0/title", "required"), ("/sections/1/id", "pattern"), ("/sections/1/activities", "minItems"),
    }


def test_gap_and_fraction_rules(spark):
    def q(i, qtype, text="", choices=0, single=True, *fractions):
        return {"id": f"q{i}", "qtype": qtype, "text": text, "choices": choices, "single": single, "answers": [{"fraction": f} for f in fractions]}

    questions = [
        q(1, "gapselect", "[[2]] and [[1]]", 2), q(2, "gapselect", "[[1]] [[1]]", 3), q(3, "gapselect", "[[1]] [[3]]", 3), q(4, "gapselect", "none", 3), q(5, "gapselect", "[[1]] [[2]]", 1),
        q(6, "multichoice", "", 0, True, 1, 0), q(7, "multichoice", "", 0, True, 0.5, 0.5), q(8, "multichoice", "", 0, False, 0.5, 0.5, -1), q(9, "multichoice", "", 0, False, 0.3333, 0.3333, 0.3333),
        q(10, "truefalse", "", 0, True, 1, 1), q(11, "numerical", "", 0, True, 0.5, 1), q(12, "shortanswer", "", 0, True, 0.9), q(13, "multichoice"), q(14, "essay"),
    ]
    b = blueprint(spark, [{"id": "s1", "title": "T", "subsections": [], "activities": [{"id": "s1.quiz1", "type": "quiz", "title": "Q", "questions": questions}]}])
    at = lambda df: sorted(int(r["path"].rsplit("/", 1)[1]) + 1 for r in df.collect())
    assert at(B.gap_errors(b)) == [2, 3, 4, 5]
    assert at(B.fraction_errors(b)) == [7, 10, 12, 13]


def activity(ident, **more):
    return {"id": ident, "type": "page", "title": "P", "refs": [], "competencies": [], "needs": [], "questions": [], **more}


def test_regenerated_at_any_depth(spark):
    """One edit a blueprint: which are taken, and that nothing off the path changes."""
    quiz = activity("s1.quiz1", type="quiz", questions=[{"id": "q1", "qtype": "essay", "text": "a"}, {"id": "q2", "qtype": "essay", "text": "b"}])
    sub = {"id": "s1-0", "title": "U", "activities": [activity("s1-0.page1"), activity("s1-0.page2")]}
    sections = [{"id": "s1", "title": "T", "objectives": ["o1"], "activities": [quiz, activity("s1.page2")], "subsections": [sub]}, {"id": "s2", "title": "T", "objectives": [], "activities": [activity("s2.page1", needs=["s1-0.page2"])], "subsections": []}]
    cases = [
        ("s1-0", "subsection", {**sub, "title": "new"}, "replaced", 0),
        ("s1-0", "subsection", {**sub, "activities": [activity("s1-0.page1")]}, "lost ids", 1),
        ("s1.page2", "activity", activity("s1.page2", title="new"), "replaced", 0),
        ("s1.page2", "activity", activity("s1.page3"), "lost ids", 1),
        ("s1.page2", "activity", activity("s1.page2", needs=["nobody"]), "invalid", 1),
        ("s1.page2", "activity", activity("s1.page2", title="x" * 256, type="poem"), "invalid", 2),
        ("q2", "question", {"id": "q2", "qtype": "essay", "text": "new"}, "replaced", 0),
        ("q2", "question", {"id": "q2", "qtype": "numerical", "answers": [{"fraction": 0.5}]}, "invalid", 1),
        ("s2", "section", {**sections[1], "title": "new"}, "replaced", 0),
        ("q2", "activity", activity("q2"), "unknown node", 0),
        ("s7", "section", sections[0], "unknown node", 0),
    ]
    rows = [(n, json.dumps(sections), c[0], *[json.dumps(c[2]) if c[1] == k else None for k in B.NODES]) for n, c in enumerate(cases)]
    edits = spark.createDataFrame(rows, "bp long, j string, node_id string, section string, subsection string, activity string, question string")
    edits = edits.selectExpr("bp", f"from_json(j, 'array<{B.SECTION}>') as sections", "node_id", *[f"from_json({k}, '{kind}') as {k}" for k, kind in B.NODES.items()]).cache()
    every = edits.select("bp", "sections").union(edits.where("bp = 0").selectExpr("99L", "sections"))
    out = {r["bp"]: r for r in B.regenerated(every, edits.drop("sections")).collect()}
    old = {r["bp"]: r["sections"] for r in edits.collect()}
    assert out[99]["outcome"] is None and out[99]["sections"] == old[0]
    for n, (_, _, _, outcome, count) in enumerate(cases):
        assert (out[n]["outcome"], out[n]["missing"] or out[n]["invalid"]) == (outcome, count), n
        assert (out[n]["sections"] == old[n]) == (outcome != "replaced"), n
    new = {n: out[n]["sections"] for n in (0, 2, 6)}
    assert new[0][0]["subsections"][0]["title"] == "new" and new[0][0]["activities"] == old[0][0]["activities"] and new[0][1] == old[0][1]
    assert new[2][0]["activities"][1]["title"] == "new" and new[2][0]["activities"][0] == old[0][0]["activities"][0]
    assert [q["text"] for q in new[6][0]["activities"][0]["questions"]] == ["a", "new"]


def test_blueprints_follow_their_input(spark, sf, tmp_path):
    """Nothing is kept of an input that was replaced."""
    from docloom.plans import blueprints as P

    whole = spark.read.parquet(f"{sf}/lineitem.parquet")
    for orders in (100, 40):
        whole.where(f"l_orderkey <= {orders}").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        want = whole.where(f"l_orderkey <= {orders}").select("l_orderkey").distinct().count()
        assert P.blueprints(spark, str(tmp_path)).count() == want


def test_repeated_and_null_paths_of_steps(spark):
    rows = [(1, 1, "course", "course", "course", None), (1, 2, "section", "s1", "/s/0", "course"), (1, 3, "section", "s1", "/s/0", "course"), (1, 4, "activity", "a", "/s/0/a/0", "/s/0"), (1, 5, "section", "s2", None, "course"), (1, 6, "activity", "b", None, None)]
    steps = spark.createDataFrame(rows, "bp int, step int, kind string, id string, path string, parent_path string").selectExpr("*", "false as done", "step = 2 as fails")
    kinds = spark.createDataFrame([(1, "/s/0/a/0", "page")], "bp int, path string, type string")
    got = {r["step"]: r["status"] for r in B.resolved(steps, kinds).collect()}
    assert got == {1: "created", 2: "failed", 3: "created", 4: "failed", 5: "created", 6: "created"}


def test_second_run_links_and_creates_nothing(spark, sf):
    from docloom.plans import blueprints as P

    wanted, framework, built, links = P.link_tables(spark, sf)
    new, warnings = B.competency_links(wanted, framework, built, links)
    new = new.cache()
    assert new.count() > 0 and warnings.count() > 0
    assert new.count() == new.distinct().count()
    again, still = B.competency_links(wanted, framework, built, links.union(new))
    assert again.count() == 0 and still.count() == warnings.count()
    asked = spark.createDataFrame([(1, 2, "Star", ["a", "b"]), (1, 1, " Star ", ["a", "c", "d"]), (1, 3, "All", None), (2, 1, "Star", ["d"])], "bp int, pos int, name string, criteria array<string>")
    built = spark.createDataFrame([(1, "a", 10, True), (1, "c", 11, False), (2, "d", 12, True)], "bp int, activity string, cmid long, tracked boolean")
    none = spark.createDataFrame([], "bp int, name string")
    made, lost = B.new_badges(asked, none, built)
    assert sorted(map(tuple, made.collect())) == [(1, "All", True, []), (1, "Star", False, [10]), (2, "Star", False, [12])]
    assert [tuple(r) for r in lost.collect()] == [(1, "Star", "c, d")]
    assert B.new_badges(asked, made.select("bp", "name"), built)[0].count() == 0
