"""Rules of blueprints that are read in the document's row: what they give, and that documents and their nodes aren't shuffled."""

import json

from pyspark.sql import functions as F

from docloom import plans
from docloom.operators import blueprints as B


def activity(ident, **more):
    return {"id": ident, "type": "page", "title": "P", "refs": [], "competencies": [], "needs": [], "questions": [], **more}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_nodes_of_odd_paths(spark):
    quiz = activity("s1.quiz1", questions=[{"id": "q1"}, {"id": None}])
    sub = {"id": "s1-0", "title": "U", "activities": [activity("s1-0.page1", questions=[{"id": "q3"}]), activity("s1-0.page2", questions=None)]}
    sections = [{"id": "s1", "title": "T", "objectives": ["o1", "o2"], "activities": [quiz], "subsections": [sub]}, {"id": "s2"}]
    every = spark.createDataFrame([(1, json.dumps(sections)), (2, "[]"), (3, None)], "bp long, j string").select("bp", F.from_json("j", f"array<{B.SECTION}>").alias("sections"))
    want = {
        "/sections/0": "/sections/0", "/sections/0/title": "/sections/0", "/sections/1/activities/0/title": "/sections/1", "/sections/0/objectives/1/text": "/sections/0/objectives/1", "/sections/0/objectives/2": "/sections/0",
        "/sections/0/activities/0/questions/1/answers/0": "/sections/0/activities/0/questions/1", "/sections/0/activities/0/questions/2": "/sections/0/activities/0", "/sections/0/activities/1": "/sections/0",
        "/sections/0/subsections/0/activities/0/questions/0": "/sections/0/subsections/0/activities/0/questions/0", "/sections/0/subsections/0/activities/1/questions/0": "/sections/0/subsections/0/activities/1",
        "/sections/0/subsections/0/objectives/0": "/sections/0/subsections/0", "/sections/0/subsections/1": "/sections/0", "/sections/01": None, "/sections/-1": None, "/sections/2": None, "/sections/+0": None, "/sections/x": None,
        "/sections": None, "sections/0": None, "": None, "/": None, "/title": None, "/sections/0/": "/sections/0", "/sections/00/activities/0": None, "/sections/99999999999/id": None,
    }
    errors = spark.createDataFrame([(bp, e) for bp in (1, 1, 2, 3, None) for e in want] + [(1, None)], "bp long, error string")
    got = {(r["bp"], r["error"]): r for r in B.nearest_nodes(every, errors).collect()}
    assert {k: r["path"] for k, r in got.items()} == {(1, e): path for e, path in want.items() if path}
    assert [got[1, e]["id"] for e in ("/sections/0/objectives/1/text", "/sections/0/activities/0/questions/1/answers/0", "/sections/1/activities/0/title")] == ["o2", None, "s2"]


def test_nearest_nodes_of_own_errors_shuffle_items_only(spark, sf):
    plan = plan_of(plans.QUERIES["bp_nearest_node"](spark, sf))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_regenerated_shuffles_items_only(spark, sf):
    plan = plan_of(plans.QUERIES["bp_regenerated"](spark, sf))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_regenerated_counts_what_the_rules_find(spark):
    """Errors that a new section brings, found in the row, are as many as those of the rules over tables."""
    good = {"id": "s1", "title": "T", "objectives": ["o1"], "activities": [activity("s1.page1", refs=["src1"], url="https://a")], "subsections": []}
    other = {"id": "s2", "title": "T", "objectives": [], "activities": [activity("s2.page1", needs=["s1.page1", "gone"]), activity("s2.page1")], "subsections": [{"id": "s2-0", "title": "", "activities": []}]}
    asked = [
        {"id": "q1", "qtype": "multichoice", "single": True, "answers": [{"fraction": 0.5}], "objective_ref": "o1"}, {"id": "q1", "qtype": "numerical", "answers": [], "objective_ref": "o9"},
        {"id": "x", "qtype": "gapselect", "text": "[[2]]", "choices": 1, "answers": []}, {"id": None, "qtype": "riddle", "answers": []},
    ]
    cases = [
        good, {**good, "title": "x" * 300}, {**good, "objectives": ["o1", "o1"], "activities": [activity("s1.page1", refs=["src1", "src2", None], needs=["s2.page1", "no", None], url="https://b", type="poem")]},
        {**good, "activities": [activity("s1.page1", questions=asked), activity("s2.page1", title=""), activity(None, url="https://a/x")], "subsections": [{"id": "s2-0", "title": None, "activities": [activity("s1.page1")]}]},
    ]
    parsed = lambda rows: spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "bp long, j string").select("bp", F.from_json("j", f"array<{B.SECTION}>").alias("sections"))
    old = parsed((i, [good, other]) for i, _ in enumerate(cases)).cache()
    new = parsed((i, [c, other]) for i, c in enumerate(cases)).cache()
    sources = spark.createDataFrame([(i, s) for i in range(3) for s in ("src1", None)], "bp long, id string")
    texts = spark.createDataFrame([(2, "see https://a"), (3, None), (1, "https://a")], "bp long, text string")
    edits = new.select("bp", F.lit("s1").alias("node_id"), F.get("sections", F.lit(0)).alias("section"), *[F.lit(None).cast(B.NODES[k]).alias(k) for k in ("subsection", "activity", "question")])
    for more in ({}, {"sources": sources}, {"sources": sources, "texts": texts}):
        found = B.errors(new, more.get("sources"), more.get("texts")).distinct()
        want = {r["bp"]: r["count"] for r in found.exceptAll(B.errors(old, more.get("sources"), more.get("texts")).distinct()).groupBy("bp").count().collect()}
        got = {r["bp"]: r["invalid"] for r in B.regenerated(old, edits, **more).collect()}
        assert got == {i: want.get(i, 0) for i, _ in enumerate(cases)} and got[0] == 0 and got[3] > 9
