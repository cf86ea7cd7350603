"""Course blueprints: nested documents flattened to relations, checked by joins, and steps of their build in order.

A blueprint has ``sections`` with ``activities`` and ``subsections`` (with activities of their
own); activities hold questions. A document is a row, so flattening needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANSWER = "struct<fraction:decimal(6,4)>"
QUESTION = f"struct<id:string,qtype:string,single:boolean,objective_ref:string,text:string,choices:int,answers:array<{ANSWER}>>"
ACTIVITY = f"struct<id:string,type:string,title:string,refs:array<string>,url:string,review:boolean,competencies:array<string>,needs:array<string>,questions:array<{QUESTION}>>"
SUBSECTION = f"struct<id:string,title:string,review:boolean,activities:array<{ACTIVITY}>>"
SECTION = f"struct<id:string,title:string,review:boolean,objectives:array<string>,activities:array<{ACTIVITY}>,subsections:array<{SUBSECTION}>>"
BLUEPRINT = f"bp bigint, sections array<{SECTION}>"

# Shape of a blueprint's fields. Fixed values of the data model
ACTIVITY_TYPES = ("page", "book", "label", "url", "resource", "folder", "quiz", "lesson", "assign", "forum", "glossary", "wiki", "choice", "feedback", "h5pactivity", "scorm")
QUESTION_TYPES = ("multichoice", "truefalse", "shortanswer", "numerical", "matching", "essay", "gapselect", "ddwtos", "multianswer")
SECTION_ID, SUBSECTION_ID, ACTIVITY_ID, QUESTION_ID = r"\As[0-9]+\z", r"\As[0-9]+-[0-9]+\z", r"\As[0-9]+(-[0-9]+)?\.[a-z][a-z0-9]*[0-9]\z", r"\Aq[0-9]+\z"

#: A field of a node by its name: of rows of nodes, or of a node in its document.
Field = Callable[[str], Column]

#: Kinds of activity without a builder.
UNBUILT = ("h5pactivity", "scorm")
NAME_LIMIT = 255
#: Most characters of a course's names.
FULL_NAME_LIMIT, SHORT_NAME_LIMIT = 254, 100
#: Jumps of a lesson's answers that name no page.
JUMPS = ("", "next", "end", "this")
TOLERANCE = "0.0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_boxes(sections: Column, find: Callable[[Column, str, Column], Column]) -> Column:
    """What ``find(box, kind, path)`` gives (arrays) for each section and subsection, as one array in document order."""
    return F.flatten(F.transform(sections, lambda s, i: in_section_boxes(s, i, find)))


def in_section_boxes(section: Column, number: Column, find: Callable[[Column, str, Column], Column]) -> Column:
    """``in_boxes`` of the section with that number."""
    path = F.concat(F.lit("/sections/"), number.cast("string"))
    inner = F.transform(some(section["subsections"], SUBSECTION), lambda u, j: find(u, "subsection", F.concat(path, F.lit("/subsections/"), j.cast("string"))))
    return F.concat(find(section, "section", path), F.flatten(inner))


def some(values: Column, kind: str) -> Column:
    """An array; none for null."""
    return F.coalesce(values, F.array().cast(f"array<{kind}>"))


def in_questions(box: Column, path: Column, find: Callable[[Column, Column], Column]) -> Column:
    """What ``find(question, path)`` gives for each question of a section or subsection, as an array."""
    of_activity = lambda a, i: F.transform(some(a["questions"], QUESTION), lambda q, j: find(q, F.concat(path, F.lit("/activities/"), i.cast("string"), F.lit("/questions/"), j.cast("string"))))
    return F.flatten(F.transform(some(box["activities"], ACTIVITY), of_activity))


def containers(blueprints: DataFrame) -> DataFrame:
    """``bp, si, ui, path, id, parent, title, review, objectives, activities``: sections (ui -1) and subsections, with their JSON pointers."""
    sections = blueprints.select("bp", F.posexplode("sections").alias("si", "s"))
    path = F.concat(F.lit("/sections/"), F.col("si").cast("string"))
    own = F.struct(F.lit(-1).alias("ui"), path.alias("path"), F.col("s.id").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("s.title").alias("title"), F.col("s.review").alias("review"), F.col("s.objectives").alias("objectives"), F.col("s.activities").alias("activities"))
    inner = F.transform("s.subsections", lambda u, i: F.struct(i.alias("ui"), F.concat(path, F.lit("/subsections/"), i.cast("string")).alias("path"), u["id"].alias("id"), F.col("s.id").alias("parent"), u["title"].alias("title"), u["review"].alias("review"), F.array().cast("array<string>").alias("objectives"), u["activities"].alias("activities")))
    return sections.select("bp", "si", F.explode(F.concat(F.array(own), F.coalesce(inner, F.array().cast(inner_type())))).alias("c")).select("bp", "si", "c.*")


def inner_type() -> str:
    return f"array<struct<ui:int,path:string,id:string,parent:string,title:string,review:boolean,objectives:array<string>,activities:array<{ACTIVITY}>>>"


def activities(blueprints: DataFrame) -> DataFrame:
    """``bp, si, ui, ai, path, container`` and the activity's fields."""
    rows = containers(blueprints).select("bp", "si", "ui", F.col("path").alias("at"), F.col("id").alias("container"), F.posexplode("activities").alias("ai", "a"))
    return rows.select("bp", "si", "ui", "ai", F.concat("at", F.lit("/activities/"), F.col("ai").cast("string")).alias("path"), "container", "a.*")


def questions(blueprints: DataFrame) -> DataFrame:
    """``bp, si, ui, ai, qi, path, activity`` and the question's fields."""
    rows = activities(blueprints).select("bp", "si", "ui", "ai", F.col("path").alias("at"), F.col("id").alias("activity"), F.posexplode("questions").alias("qi", "q"))
    return rows.select("bp", "si", "ui", "ai", "qi", F.concat("at", F.lit("/questions/"), F.col("qi").cast("string")).alias("path"), "activity", "q.*")


def node_ids(blueprints: DataFrame) -> DataFrame:
    """``bp, kind, id, path, place`` of every node; ``place`` sorts in document order (a subsection after its section's activities)."""
    # one explode of the container's nodes keeps this a single pass over the documents
    place = lambda *parts: F.struct(*[p.cast("int").alias(f"p{i}") for i, p in enumerate((*parts, *([F.lit(-1)] * (4 - len(parts)))))])
    node = lambda kind, ident, path, order: F.struct(F.lit(kind).alias("kind"), ident.alias("id"), path.alias("path"), order.alias("place"))
    rows = containers(blueprints)
    si, ui, path = F.col("si"), F.col("ui"), F.col("path")
    own = F.array(F.struct(F.when(ui < 0, "section").otherwise("subsection").alias("kind"), F.col("id").alias("id"), path.alias("path"), place(si, ui).alias("place")))
    objectives = F.transform("objectives", lambda o, i: node("objective", o, F.concat(path, F.lit("/objectives/"), i.cast("string")), place(si, ui, F.lit(-1), i)))
    made = F.transform("activities", lambda a, i: node("activity", a["id"], F.concat(path, F.lit("/activities/"), i.cast("string")), place(si, ui, i)))
    asked = F.flatten(F.transform("activities", lambda a, i: F.transform(a["questions"], lambda q, j: node("question", q["id"], F.concat(path, F.lit("/activities/"), i.cast("string"), F.lit("/questions/"), j.cast("string")), place(si, ui, i, j)))))
    return rows.select("bp", F.explode(F.concat(own, objectives, made, asked)).alias("n")).select("bp", "n.*")


def section_nodes(section: Column, number: Column) -> Column:
    """``array<struct<kind, id, path>>`` of a section's nodes, in document order."""
    node = lambda kind, ident, path: F.struct(F.lit(kind).alias("kind"), ident.alias("id"), path.alias("path"))

    def of_box(box: Column, kind: str, path: Column) -> Column:
        objectives = box["objectives"] if kind == "section" else F.array().cast("array<string>")

        def of_activity(a: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("/activities/"), i.cast("string"))
            return F.concat(F.array(node("activity", a["id"], at)), F.transform(some(a["questions"], QUESTION), lambda q, j: node("question", q["id"], F.concat(at, F.lit("/questions/"), j.cast("string")))))

        goals = F.transform(some(objectives, "string"), lambda o, i: node("objective", o, F.concat(path, F.lit("/objectives/"), i.cast("string"))))
        return F.concat(F.array(node(kind, box["id"], path)), goals, F.flatten(F.transform(some(box["activities"], ACTIVITY), of_activity)))

    return in_section_boxes(section, number, of_box)


def duplicate_ids(blueprints: DataFrame) -> DataFrame:
    """``bp, kind, id, path``: every node whose id a node of its kind had before it."""
    kind = F.when(F.col("kind") == "subsection", "section").otherwise(F.col("kind"))
    rows = node_ids(blueprints).withColumn("kind", kind)
    nth = F.row_number().over(Window.partitionBy("bp", "kind", "id").orderBy("place"))
    return rows.withColumn("nth", nth).where("nth > 1").select("bp", "kind", "id", "path")


def long_names(blueprints: DataFrame, most: int = NAME_LIMIT) -> DataFrame:
    """``bp, path, chars`` of titles that are too long, in characters."""
    titles = containers(blueprints).select("bp", "path", "title").union(activities(blueprints).select("bp", "path", "title"))
    return titles.where(F.char_length("title") > most).select("bp", F.concat("path", F.lit("/title")).alias("path"), F.char_length("title").alias("chars"))


def long_course_names(courses: DataFrame) -> DataFrame:
    """The other columns and ``field, chars`` of course names that are too long. Courses have ``fullname`` and ``shortname``; null ones are not too long."""
    field = lambda name, most: F.when(F.char_length(name) > most, F.struct(F.lit(name).alias("field"), F.char_length(name).alias("chars")))
    rows = courses.withColumn("f", F.explode(F.array_compact(F.array(field("fullname", FULL_NAME_LIMIT), field("shortname", SHORT_NAME_LIMIT)))))
    return rows.drop("fullname", "shortname").select("*", "f.*").drop("f")


def feedback_range_errors(items: DataFrame) -> DataFrame:
    """Numeric feedback ``items(type, min, max)`` whose least value is over the greatest; a null bound is none."""
    return items.where((F.col("type") == "numeric") & (F.col("min") > F.col("max")))


def broken_jumps(pages: DataFrame) -> DataFrame:
    """``lesson, page, answer, jumpto``: answers that jump to a page their lesson doesn't have. ``pages(lesson, page, jumps array<string>)``."""
    each = pages.select("lesson", "page", F.posexplode("jumps").alias("answer", "jumpto")).where(~F.col("jumpto").isin(*JUMPS))
    known = pages.select(F.col("lesson").alias("of"), F.col("page").alias("target"))
    return each.join(known, (F.col("lesson") == F.col("of")) & (F.col("jumpto") == F.col("target")), "left_anti")


def placed(path: Column) -> list[Column]:
    """Numbers of the section, subsection, activity and question in a node's path; null for levels that the path lacks."""
    at = lambda level: F.nullif(F.regexp_extract(path, rf"/{level}/([0-9]+)", 1), F.lit("")).cast("int")
    return [at(level) for level in ("sections", "subsections", "activities", "questions")]


def with_node(sections: Column, path: Column, section: Column, subsection: Column, activity: Column, question: Column) -> Column:
    """``sections`` with the node at ``path`` replaced by the one of its kind; all that is not on the path stays as it is."""
    numbers = F.struct(*[n.alias(f"n{i}") for i, n in enumerate(placed(path))])
    return let(numbers, lambda at: _with_node(sections, [at[f"n{i}"] for i in range(4)], section, subsection, activity, question))


def _with_node(sections: Column, at: list[Column], section: Column, subsection: Column, activity: Column, question: Column) -> Column:
    si, ui, ai, qi = at

    def swapped(nodes: Column, at: Column, change: Column) -> Column:
        return F.transform(nodes, lambda n, i: F.when(i == at, change(n)).otherwise(n))

    def in_activities(box: Column) -> Column:
        inner = lambda a: F.when(qi.isNull(), activity).otherwise(a.withField("questions", swapped(a["questions"], qi, lambda q: question)))
        return box.withField("activities", swapped(box["activities"], ai, inner))

    def in_section(s: Column) -> Column:
        box = lambda u: F.when(ai.isNull(), subsection).otherwise(in_activities(u))
        below = s.withField("subsections", swapped(s["subsections"], ui, box))
        return F.when(ui.isNotNull(), below).when(ai.isNotNull(), in_activities(s)).otherwise(section)

    return swapped(sections, si, in_section)


def errors(blueprints: DataFrame, sources: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``bp, rule, path, detail``: what all rules find. ``sources(bp, id)`` and ``texts(bp, text)`` as for the rules that take them."""
    named = lambda rule, rows, detail: rows.select("bp", F.lit(rule).alias("rule"), "path", detail.alias("detail"))
    nothing = F.lit("")
    out = named("shape", shape_errors(blueprints), F.col("keyword")).union(named("duplicate id", duplicate_ids(blueprints), F.col("id")))
    out = out.union(named("long name", long_names(blueprints), nothing)).union(named("broken reference", broken_references(blueprints, sources), F.col("ref")))
    out = out.union(named("fractions", fraction_errors(blueprints), nothing)).union(named("gaps", gap_errors(blueprints), nothing))
    return out.union(named("link without source", unsourced_urls(blueprints, texts), F.col("url"))) if texts is not None else out


NODES = {"section": SECTION, "subsection": SUBSECTION, "activity": ACTIVITY, "question": QUESTION}


def regenerated(blueprints: DataFrame, edits: DataFrame | Callable[[Column], dict[str, Column]], sources: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``blueprints`` with new nodes at any depth, and ``outcome, missing, invalid``, null where nothing is edited.

    The rules are those of shape, duplicate ids, long names, references, fractions, gaps and, with ``texts``, links. ``edits(bp, node_id, section, subsection, activity, question)``, one for each blueprint at most: the id of the node to replace (the first in
    document order that has it) and its replacement in the column of its kind. The old version stays, with the outcome

    - ``unknown node``: no node has the id, or the replacement is of another kind (its column is null);
    - ``lost ids``: the new node lacks its own id or one that something outside refers to (``missing`` counts them);
    - ``invalid``: a rule finds what it didn't find in the old version (``invalid`` counts that).

    Otherwise it is ``replaced``. All is read in the document's row: what is given as tables meets it by one join each, and ``edits`` can be a function of
    ``sections`` that gives the columns by their names (a null ``node_id`` edits nothing), which needs none. In the section that is changed all rules are checked, for both versions;
    elsewhere an edit can only change which ids are there twice and which references are broken.
    """
    rows, given = blueprints, edits
    if isinstance(edits, DataFrame):
        named = edits.select(F.col("bp").alias("edit_of"), F.struct("node_id", *NODES).alias("edit_"))
        rows = rows.join(named, F.col("bp") == F.col("edit_of"), "left")
    edit = lambda s: F.col("edit_") if isinstance(given, DataFrame) else F.when((e := given(s))["node_id"].isNotNull(), F.struct(*[e[c].alias(c) for c in ("node_id", *NODES)]))
    for name, more, value in (("source_ids_", sources, "id"), ("texts_", texts, "text")):
        if more is not None:
            more = more.groupBy(F.col("bp").alias(f"of_{name}")).agg(F.collect_set(value).alias(name))
            rows = rows.join(more, F.col("bp") == F.col(f"of_{name}"), "left")
    ids = some(F.col("source_ids_"), "string") if sources is not None else None
    judged = lambda s: let(edit(s), lambda e: F.when(e.isNotNull(), _judged(s, e, ids, F.col("texts_") if texts is not None else None)))
    # an array that is exploded, as a filter on its values would else be moved below and judge everything twice
    rows = rows.withColumn("judged_", F.array(let(F.col("sections"), judged)))
    rows = rows.withColumn("judged_", F.explode("judged_"))
    changed = let(F.col("sections"), lambda s: let(edit(s), lambda e: with_node(s, F.col("judged_.path"), *[e[k] for k in NODES])))
    made = F.when(F.col("judged_.outcome") == "replaced", changed).otherwise(F.col("sections"))
    return rows.select(*[made.alias(c) if c == "sections" else c for c in blueprints.columns], "judged_.outcome", "judged_.missing", "judged_.invalid")


def _judged(sections: Column, edit: Column, sources: Column | None, texts: Column | None) -> Column:
    """``struct<outcome, missing, invalid, path>`` of a document's edit; ``path`` is that of the node it replaces."""
    count = lambda x: F.size(x).cast("long")
    result = lambda outcome, missing, invalid, path: F.struct(outcome.alias("outcome"), missing.alias("missing"), invalid.alias("invalid"), path.alias("path"))

    def at_hit(hit: Column, nodes: Column) -> Column:
        fits = F.coalesce(*[F.when(hit["kind"] == k, edit[k].isNotNull()) for k in NODES], F.lit(False))
        changed = F.when(fits, with_node(sections, hit["path"], *[edit[k] for k in NODES]))
        judged = lambda c: F.when(c.isNotNull(), let(F.transform(sections, section_references), lambda refs: compared(c, hit["path"], nodes, refs)))
        return let(changed, lambda c: F.coalesce(judged(c), result(F.lit("unknown node"), F.lit(0).cast("long"), F.lit(0).cast("long"), hit["path"])))

    def compared(changed: Column, target: Column, nodes: Column, refs: Column) -> Column:
        """``nodes`` and ``refs`` are those of each section."""
        si = placed(target)[0]
        both = lambda of: let(si, lambda i: F.struct(i.alias("i"), of(F.get(sections, i), i).alias("old"), of(F.get(changed, i), i).alias("new")))
        swapped = lambda lists, x: F.flatten(F.transform(lists, lambda n, i: F.when(i == x["i"], x["new"]).otherwise(n)))

        def counts(n: Column, r: Column, local: Column) -> Column:
            under = lambda p: (p == target) | p.startswith(F.concat(target, F.lit("/")))
            ids = lambda some_nodes: F.transform(F.filter(some_nodes, lambda x: under(x["path"]) & x["id"].isNotNull()), lambda x: x["id"])
            outside = F.transform(F.filter(F.flatten(refs), lambda x: (x["kind"] != "source") & x["ref"].isNotNull() & ~under(x["path"])), lambda x: x["ref"])
            required = F.array_union(F.array_intersect(ids(n["old"]), outside), F.array(edit["node_id"]))
            missing = count(F.array_except(required, ids(n["new"])))
            old_nodes, new_nodes = F.flatten(nodes), swapped(nodes, n)
            found = lambda own, all_nodes, all_refs: let(all_nodes, lambda x: F.concat(own, _repeated(x), _broken(all_refs, x, sources)))
            invalid = count(F.array_except(found(local["new"], new_nodes, swapped(refs, r)), found(local["old"], old_nodes, F.flatten(refs))))
            outcome = lambda m, v: F.when(m > 0, "lost ids").when(v > 0, "invalid").otherwise("replaced")
            return let(F.struct(missing.alias("m"), invalid.alias("v")), lambda x: result(outcome(x["m"], x["v"]), x["m"], x["v"], target))

        local = both(lambda s, i: section_errors(s, i, texts))
        return let(F.struct(both(section_nodes).alias("n"), both(section_references).alias("r"), local.alias("l")), lambda x: counts(x["n"], x["r"], x["l"]))

    located = lambda nodes: F.get(F.filter(F.flatten(nodes), lambda n: n["id"] == edit["node_id"]), F.lit(0))
    return let(F.transform(sections, section_nodes), lambda nodes: let(located(nodes), lambda hit: at_hit(hit, nodes)))


def _error(rule: str, path: Column, detail: Column | str = "") -> Column:
    """An error as one text; texts are equal if all of it is."""
    return F.concat_ws("\0", F.lit(rule), path, F.lit(detail) if isinstance(detail, str) else detail)


def section_references(section: Column, number: Column) -> Column:
    """``array<struct<path, kind, ref>>`` of a section."""
    return in_section_boxes(section, number, lambda box, kind, path: box_references(some(box["activities"], ACTIVITY), path))


def section_errors(section: Column, number: Column, texts: Column | None = None) -> Column:
    """Errors of a section, as texts, that its own nodes decide: their shape, long names, fractions, gaps, and links that none of ``texts`` has."""
    of = lambda node: lambda name: node[name]
    shape = lambda checks: [F.when(c.isNotNull(), _error("shape", c["path"], c["keyword"])) for c in checks]
    long = lambda node, path: F.when(F.char_length(node["title"]) > NAME_LIMIT, _error("long name", F.concat(path, F.lit("/title"))))

    def of_box(box: Column, kind: str, path: Column) -> Column:
        def of_activity(a: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("/activities/"), i.cast("string"))
            own = [*shape(activity_checks(of(a), at)), long(a, at)]
            if texts is not None:
                sourced = F.coalesce(F.exists(texts, lambda t: t.contains(a["url"])), F.lit(False))
                own.append(F.when(a["url"].isNotNull() & texts.isNotNull() & ~sourced, _error("link without source", at, a["url"])))
            return F.concat(F.array(*own), F.flatten(F.transform(some(a["questions"], QUESTION), lambda q, j: of_question(q, F.concat(at, F.lit("/questions/"), j.cast("string"))))))

        own = [*shape(box_checks(of(box), path, F.lit(kind == "section"))), long(box, path)]
        return F.concat(F.array(*own), F.flatten(F.transform(some(box["activities"], ACTIVITY), of_activity)))

    def of_question(q: Column, at: Column) -> Column:
        return F.array(*shape(question_checks(of(q), at)), F.when(~fractions_fit(of(q)), _error("fractions", at)), F.when(gaps_are_wrong(of(q)), _error("gaps", at)))

    return F.array_compact(in_section_boxes(section, number, of_box))


def _repeated(nodes: Column) -> Column:
    """Errors, as texts, of nodes whose id a node of their kind had before them. ``nodes(kind, id, path)`` in document order."""
    kind = lambda n: F.when(n["kind"] == "subsection", "section").otherwise(n["kind"])
    placed_ = F.array_sort(F.transform(nodes, lambda n, i: F.struct(kind(n).alias("kind"), n["id"].alias("id"), i.alias("i"), n["path"].alias("path"))))
    same = lambda a, b: (a["kind"] == b["kind"]) & a["id"].eqNullSafe(b["id"])
    return let(placed_, lambda x: F.transform(F.filter(x, lambda n, i: F.when(i > 0, same(n, F.get(x, i - 1))).otherwise(False)), lambda n: _error("duplicate id", n["path"], n["id"])))


def _broken(refs: Column, nodes: Column, sources: Column | None) -> Column:
    """Errors, as texts, of references to activities, objectives and, if they are given, ``sources`` that aren't there."""
    key = lambda kind, name: F.concat(kind, F.lit("\0"), name)
    there = F.transform(F.filter(nodes, lambda n: n["kind"].isin("activity", "objective") & n["id"].isNotNull()), lambda n: key(n["kind"], n["id"]))
    if sources is None:
        refs = F.filter(refs, lambda r: r["kind"] != "source")
    else:
        there = F.concat(there, F.transform(sources, lambda s: key(F.lit("source"), s)))
    lost = lambda r: F.array_except(F.transform(r, lambda x: key(x["kind"], x["ref"])), there)
    gone = lambda r: let(lost(r), lambda m: F.filter(r, lambda x: x["ref"].isNull() | F.array_contains(m, key(x["kind"], x["ref"]))))
    return let(refs, lambda r: F.transform(gone(r), lambda x: _error("broken reference", x["path"], x["ref"])))


def enum_errors(blueprints: DataFrame, types: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """``bp, path, value, allowed``: unknown kinds of activities and questions, with what is allowed there."""
    wrong = lambda rows, field, values: rows.where(~F.col(field).isin(*values)).select("bp", F.concat("path", F.lit(f"/{field}")).alias("path"), F.col(field).alias("value"), F.lit(", ".join(values)).alias("allowed"))
    return wrong(activities(blueprints), "type", types).union(wrong(questions(blueprints), "qtype", kinds))


def references(blueprints: DataFrame) -> DataFrame:
    """``bp, path, kind, ref``: what activities need (activity) and cite (source), and what questions are about (objective), in one pass over the documents."""
    return containers(blueprints).select("bp", F.explode(box_references(F.col("activities"), F.col("path"))).alias("r")).select("bp", "r.*")


def box_references(activities: Column, path: Column) -> Column:
    """``array<struct<path, kind, ref>>`` of the activities at ``path``."""
    ref = lambda at, kind, name: F.struct(at.alias("path"), F.lit(kind).alias("kind"), name.alias("ref"))

    def of_activity(a: Column, i: Column) -> Column:
        at = F.concat(path, F.lit("/activities/"), i.cast("string"))
        asked = F.transform(a["questions"], lambda q, j: ref(F.concat(at, F.lit("/questions/"), j.cast("string")), "objective", q["objective_ref"]))
        lists = F.transform(a["needs"], lambda n: ref(at, "activity", n)), F.transform(a["refs"], lambda s: ref(at, "source", s)), F.filter(asked, lambda r: r["ref"].isNotNull())
        none = F.array().cast("array<struct<path:string,kind:string,ref:string>>")
        return F.concat(*[F.coalesce(x, none) for x in lists])

    return F.flatten(F.transform(activities, of_activity))


def broken_references(blueprints: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``bp, path, kind, ref``: references to activities and objectives that don't exist, and to sources if ``sources(bp, id)`` are given."""
    ids = node_ids(blueprints).where(F.col("kind").isin("activity", "objective")).select("bp", F.col("kind").alias("of"), F.col("id").alias("target"))
    refs = references(blueprints)
    if sources is None:
        refs = refs.where("kind <> 'source'")
    else:
        ids = ids.union(sources.select("bp", F.lit("source"), "id"))
    ids = ids.withColumnRenamed("bp", "owner")
    return refs.join(ids, (F.col("bp") == F.col("owner")) & (F.col("kind") == F.col("of")) & (F.col("ref") == F.col("target")), "left_anti")


def fractions_fit(question: Field, tolerance: str = TOLERANCE) -> Column:
    """Whether a question's answers are worth what its kind asks for."""
    eps, one = F.lit(tolerance).cast("decimal(6,4)"), F.lit(1).cast("decimal(6,4)")
    fractions = F.transform(question("answers"), lambda a: a["fraction"])
    near = lambda x: F.abs(x - one) <= eps
    total = F.aggregate(F.filter(fractions, lambda f: f > 0), F.lit(0).cast("decimal(16,4)"), lambda acc, f: (acc + f).cast("decimal(16,4)"))
    full = F.size(F.filter(fractions, near))
    return (
        F.when((question("qtype") == "multichoice") & question("single"), F.coalesce(near(F.array_max(fractions)), F.lit(False)))
        .when(question("qtype") == "multichoice", near(total))
        .when(question("qtype") == "truefalse", full == 1)
        .when(question("qtype").isin("shortanswer", "numerical"), full >= 1)
        .otherwise(True)
    )


def fraction_errors(blueprints: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """``bp, path, qtype``: single choices whose best answer isn't worth 1, multiple ones whose right answers don't sum to 1, others without a full answer."""
    return questions(blueprints).where(~fractions_fit(F.col, tolerance)).select("bp", "path", "qtype")


def gaps_are_wrong(question: Field) -> Column:
    """Whether a gap question's markers aren't 1 to k once each, or have no choice."""
    numbers = F.transform(F.regexp_extract_all(question("text"), F.lit(r"\[\[([0-9]{1,9})\]\]"), F.lit(1)), lambda g: g.cast("int"))

    def wrong(gaps: Column) -> Column:
        n = F.size(gaps)
        return (n == 0) | (gaps != F.sequence(F.lit(1), F.greatest(F.lit(1), n))) | (n > question("choices"))

    return F.when(question("qtype") == "gapselect", let(F.array_sort(numbers), wrong)).otherwise(False)


def gap_errors(blueprints: DataFrame) -> DataFrame:
    """``bp, path``: gap questions whose ``[[n]]`` markers aren't 1 to k once each, or have no choice."""
    return questions(blueprints).where(gaps_are_wrong(F.col)).select("bp", "path")


def unsourced_urls(blueprints: DataFrame, texts: DataFrame) -> DataFrame:
    """``bp, path, url`` of links that occur in no source text of their blueprint; blueprints without sources are skipped. ``texts(bp, text)``.

    Links are compared only with texts of their own blueprint, so the join has a key.
    """
    urls = activities(blueprints).where("url is not null").select("bp", "path", "url")
    some = urls.join(texts.select("bp").distinct(), "bp", "left_semi")
    own = texts.select(F.col("bp").alias("owner"), "text")
    return some.join(own, (F.col("bp") == F.col("owner")) & F.col("text").contains(F.col("url")), "left_anti")


def located(blueprints: DataFrame, wanted: DataFrame) -> DataFrame:
    """``bp, id, kind, path`` of the first node with each wanted id in document order. ``wanted(bp, id)``."""
    rows = node_ids(blueprints).join(wanted.distinct(), ["bp", "id"], "left_semi")
    return rows.groupBy("bp", "id").agg(F.min_by(F.struct("kind", "path"), "place").alias("n")).select("bp", "id", "n.kind", "n.path")


def required_ids(blueprints: DataFrame, targets: DataFrame) -> DataFrame:
    """``bp, id``: ids in the subtree at each target path that something outside refers to, and the target's own. ``targets(bp, path)``."""
    targets = targets.select(F.col("bp").alias("tbp"), F.col("path").alias("target"))
    under = lambda path: (path == F.col("target")) | path.startswith(F.concat(F.col("target"), F.lit("/")))
    inside = node_ids(blueprints).join(targets, (F.col("bp") == F.col("tbp")) & under(F.col("path")))
    refs = references(blueprints).where("kind <> 'source'").select("bp", "path", "ref")
    outside = refs.join(targets, F.col("bp") == F.col("tbp")).where(~under(F.col("path"))).select("bp", "target", F.col("ref").alias("id")).distinct()
    needed = inside.select("bp", "target", "id").join(outside, ["bp", "target", "id"], "left_semi")
    return needed.union(inside.where(F.col("path") == F.col("target")).select("bp", "target", "id")).select("bp", "id").distinct()


def nearest(sections: Column, error: Column) -> Column:
    """``struct<id, path>`` of the node with the longest path that ``error`` starts with, null if there is none: its numbers are looked up, level by level."""

    def of_parts(parts: Column) -> Column:
        def place(nodes: Column, level: str, n: int) -> Column:
            """The number after ``level`` at part ``n``, if there is such a node."""
            text = F.get(parts, F.lit(n + 1))
            number = text.try_cast("int")
            return F.when((F.get(parts, F.lit(n)) == level) & (number.cast("string") == text) & (number >= 0) & (number < F.size(nodes)), number)

        def at(nodes: Column, level: str, n: int, inside: Callable[[Column], Column]) -> Column:
            """``inside`` of the node that the path goes through, else null."""
            return let(place(nodes, level, n), lambda i: F.when(i.isNotNull(), let(F.get(nodes, i), inside)))

        node = lambda ident, n: F.struct(ident.alias("id"), F.array_join(F.slice(parts, F.lit(1), F.lit(n)), "/").alias("path"))

        def in_box(box: Column, n: int) -> Column:
            asked = lambda a: at(a["questions"], "questions", n + 2, lambda q: node(q["id"], n + 4))
            return at(box["activities"], "activities", n, lambda a: F.coalesce(asked(a), node(a["id"], n + 2)))

        def in_section(s: Column) -> Column:
            objective = at(s["objectives"], "objectives", 3, lambda o: node(o, 5))
            subsection = at(s["subsections"], "subsections", 3, lambda u: F.coalesce(in_box(u, 5), node(u["id"], 5)))
            return F.coalesce(in_box(s, 3), objective, subsection, node(s["id"], 3))

        return F.when(F.get(parts, F.lit(0)) == "", at(sections, "sections", 1, in_section))

    return let(F.split(error, "/", -1), of_parts)


def nearest_nodes(blueprints: DataFrame, errors: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """``bp, error, id, path``: the node with the longest path that each error's path starts with. ``errors(bp, error)``, or a function of ``sections`` that gives a document's ``array<string>``.

    Nodes are looked up in their document, so errors of one's own need no shuffle, and others one by document.
    """
    if isinstance(errors, DataFrame):
        rows = blueprints.join(errors.groupBy("bp").agg(F.collect_set("error").alias("errors")), "bp")
        return nearest_nodes(rows, lambda s: F.col("errors"))
    # found before it is exploded, as the documents aren't copied then
    each = lambda s: F.transform(F.array_distinct(errors(s)), lambda e: F.struct(e.alias("error"), nearest(s, e).alias("n")))
    found = blueprints.where("bp is not null").select("bp", F.filter(let(F.col("sections"), each), lambda x: x["n"].isNotNull()).alias("found"))
    return found.select("bp", F.explode("found").alias("x")).select("bp", "x.error", "x.n.id", "x.n.path")


def too_many_types(blueprints: DataFrame, most: int = 3) -> DataFrame:
    """``bp, path, types`` of containers with more than ``most`` kinds of activity."""
    rows = containers(blueprints).select("bp", "path", F.size(F.array_distinct(F.transform("activities", lambda a: a["type"]))).alias("types"))
    return rows.where(F.col("types") > most)


def with_review_flags(blueprints: DataFrame) -> DataFrame:
    """``bp, id``: activities to review: their section or subsection is flagged, or they are, or one of their questions (``review:`` ids)."""
    rows = containers(blueprints).select("bp", F.col("review").alias("all"), F.explode("activities").alias("a"))
    asked = F.exists("a.questions", lambda q: q["text"].startswith("review:"))
    flagged = F.coalesce(F.col("all") | F.col("a.review") | asked, F.lit(False))
    return rows.where(flagged).select("bp", F.col("a.id").alias("id"))


# Build plans


def build_steps(blueprints: DataFrame, existing_course: bool = False) -> DataFrame:
    """``bp, step, kind, id, parent``: the course, then per section itself, its activities, and each subsection with its activities.

    In an existing course only activities are built, without parents.
    """
    rows = node_ids(blueprints).where(F.col("kind").isin("section", "subsection", "activity"))
    parent = F.when(F.col("kind") == "section", "course").otherwise(F.regexp_extract("path", r"\A(.*)/[a-z]+/[0-9]+\z", 1))
    rows = rows.select("bp", "kind", "id", "place", "path", parent.alias("parent_path"))
    if existing_course:
        rows = rows.where("kind = 'activity'").withColumn("parent_path", F.lit(None).cast("string"))
    else:
        first = blueprints.select("bp", F.lit("course").alias("kind"), F.lit("course").alias("id"), F.struct(*[F.lit(-1).alias(f"p{i}") for i in range(4)]).alias("place"), F.lit("course").alias("path"), F.lit(None).cast("string").alias("parent_path"))
        rows = rows.union(first)
    step = F.row_number().over(Window.partitionBy("bp").orderBy("place"))
    return rows.select("bp", step.alias("step"), "kind", "id", "path", "parent_path")


def resolved(steps: DataFrame, kinds: DataFrame) -> DataFrame:
    """``bp, step, status``: built steps are skipped, steps under a parent that isn't built fail, steps without a builder are for people, the rest is created or fails.

    ``steps`` with ``done`` and ``fails`` (booleans); ``kinds(bp, path, type)`` of activities, a row for each path. Parents are at most
    three levels up, and all in the step's blueprint: one window gathers them, looked up by path. Of steps that share
    a path the first is the parent; a step without a path is nobody's.
    """
    rows = steps.join(kinds.select("bp", "path", "type"), ["bp", "path"], "left")
    own = F.when(F.col("done"), "skipped").when(F.coalesce(F.col("type").isin(*UNBUILT), F.lit(False)), "manual").when(F.col("fails"), "failed").otherwise("created")
    rows = rows.withColumn("own", own)
    nth = F.row_number().over(Window.partitionBy("bp", "path").orderBy("step"))
    a_parent = (F.col("kind") != "activity") & F.col("path").isNotNull() & (F.col("nth") == 1)
    rows = rows.withColumn("nth", nth)
    parents = F.collect_list(F.when(a_parent, F.struct("path", F.struct("own", "parent_path")))).over(Window.partitionBy("bp"))
    out = rows.withColumn("parents", F.map_from_entries(parents))
    for name, path in (("up", "parent_path"), ("top", "up_parent"), ("course", "top_parent")):
        found = F.try_element_at("parents", F.coalesce(path, F.lit("")))
        out = out.withColumns({name: found["own"], f"{name}_parent": found["parent_path"]})
    built = lambda c: c.isin("created", "skipped")
    # a skipped step stands even where what is above it failed
    course_ok = F.col("course").isNull() | built(F.col("course"))
    top_ok = F.col("top").isNull() | (F.col("top") == "skipped") | (built(F.col("top")) & course_ok)
    up_ok = F.col("up").isNull() | (F.col("up") == "skipped") | (built(F.col("up")) & top_ok)
    status = F.when(F.col("own") == "skipped", "skipped").when(~up_ok, "failed").otherwise(F.col("own"))
    return out.select("bp", "step", "kind", "id", status.alias("status"))


def competency_activities(blueprints: DataFrame, of_course: DataFrame) -> DataFrame:
    """``bp, competency, activities``: the activities of each competency, once, in the order met; ``of_course(bp, competency, activity, pos)`` come first."""
    own = activities(blueprints).select("bp", F.explode("competencies").alias("competency"), F.col("id").alias("activity"), F.struct(F.lit(1).alias("o"), F.col("si").cast("long").alias("a"), F.col("ui").cast("long").alias("b"), F.col("ai").cast("long").alias("c")).alias("place"))
    course = of_course.select("bp", "competency", "activity", F.struct(F.lit(0).alias("o"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("place"))
    first = own.union(course).groupBy("bp", "competency", "activity").agg(F.min("place").alias("place"))
    return first.groupBy("bp", "competency").agg(F.array_sort(F.collect_list(F.struct("place", "activity"))).alias("x")).select("bp", "competency", F.col("x.activity").alias("activities"))


def competency_links(wanted: DataFrame, framework: DataFrame, built: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links to add, warnings)``: ``bp, competency, cmid`` and ``bp, competency, activity, warning``.

    ``wanted(bp, idnumber, activity)``, ``framework(idnumber, competency)``, ``built(bp, activity, cmid)``, ``links(bp, competency, cmid)``; a link
    with a null ``cmid`` is that of the course. Every competency that the framework knows is linked to its course, and to each of its
    activities that is built. What is linked already is left alone, so a second run adds nothing; repeated wishes are one.
    """
    asked = wanted.distinct().join(framework, "idnumber", "left").join(built, ["bp", "activity"], "left")
    unknown = asked.where("competency is null").select("bp", F.col("idnumber").alias("competency"), F.lit(None).cast("string").alias("activity"), F.lit("not in the framework").alias("warning")).distinct()
    known = asked.where("competency is not null")
    unbuilt = known.where("activity is not null and cmid is null").select("bp", F.col("idnumber").alias("competency"), "activity", F.lit("activity is not built").alias("warning"))
    to_course = known.select("bp", "competency", F.lit(None).cast("long").alias("cmid"))
    to_activity = known.where("cmid is not null").select("bp", "competency", F.col("cmid").cast("long").alias("cmid"))
    old = links.select(F.col("bp").alias("b"), F.col("competency").alias("c"), F.col("cmid").alias("m"))
    there = (F.col("bp") == F.col("b")) & (F.col("competency") == F.col("c")) & F.col("cmid").eqNullSafe(F.col("m"))
    return to_course.union(to_activity).distinct().join(old, there, "left_anti"), unknown.union(unbuilt)


def new_badges(wanted: DataFrame, badges: DataFrame, built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(badges to create, warnings)``: ``bp, name, course_wide, cmids`` and ``bp, name, activities``.

    ``wanted(bp, pos, name, criteria array<string>)`` with null criteria for the course as a whole, ``badges(bp, name)`` that
    there are, ``built(bp, activity, cmid, tracked)``. A name that exists is skipped, so a second run makes none; of several creators of one
    name the first by ``pos`` wins. Names are trimmed. Activities that aren't built or don't track completion are left out, with a warning.
    """
    name = F.trim("name")
    first = wanted.withColumn("name", name).groupBy("bp", "name").agg(F.min_by(F.struct("criteria"), "pos").alias("w"))
    fresh = first.join(badges.select("bp", "name").distinct(), ["bp", "name"], "left_anti").select("bp", "name", "w.criteria")
    each = fresh.select("bp", "name", F.posexplode("criteria").alias("at", "activity")).join(built.where("tracked").select("bp", "activity", "cmid"), ["bp", "activity"], "left")
    lists = each.groupBy("bp", "name").agg(F.sort_array(F.collect_set("cmid")).alias("cmids"), F.array_sort(F.collect_list(F.when(F.col("cmid").isNull(), F.struct("at", "activity")))).alias("lost"))
    made = fresh.join(lists, ["bp", "name"], "left").select("bp", "name", F.col("criteria").isNull().alias("course_wide"), F.coalesce("cmids", F.array().cast("array<bigint>")).alias("cmids"), F.transform("lost", lambda x: x["activity"]).alias("lost"))
    return made.drop("lost"), made.where(F.size("lost") > 0).select("bp", "name", F.array_join("lost", ", ").alias("activities"))


def availability(blueprints: DataFrame, built: DataFrame) -> DataFrame:
    """``bp, id, needs, missing``: activities with conditions, and how many of what they need (once each) or of themselves isn't built. ``built(bp, id)``."""
    rows = activities(blueprints).where(F.size("needs") > 0).select("bp", "id", F.array_distinct("needs").alias("needs")).distinct()
    each = rows.select("bp", "id", "needs", F.explode(F.array_distinct(F.concat(F.array("id"), "needs"))).alias("need"))
    known = built.select(F.col("bp").alias("b"), F.col("id").alias("built_id")).distinct()
    out = each.join(known, (F.col("bp") == F.col("b")) & (F.col("need") == F.col("built_id")), "left")
    return out.groupBy("bp", "id", F.array_join("needs", ",").alias("needs")).agg(F.count(F.when(F.col("built_id").isNull(), 1)).alias("missing"))


def completion_set(rows: DataFrame, criteria: DataFrame) -> DataFrame:
    """Activities (``bp, id``) that are built and tracked and not yet criteria. ``rows(bp, id, built, tracked)``, ``criteria(bp, id)``."""
    return rows.where("built and tracked").select("bp", "id").distinct().join(criteria.select("bp", "id"), ["bp", "id"], "left_anti")


def latest_records(records: DataFrame) -> DataFrame:
    """``bp, id, status, cmid``: the last record of each node; a skipped one keeps the ids and status it had before. ``records(bp, id, seq, status, cmid)``."""
    real = F.col("status") != "skipped"
    out = records.groupBy("bp", "id").agg(F.max_by("status", F.when(real, F.col("seq"))).alias("s"), F.max_by("cmid", F.when(real & F.col("cmid").isNotNull(), F.col("seq"))).alias("cmid"))
    return out.select("bp", "id", F.coalesce("s", F.lit("skipped")).alias("status"), "cmid")


def progress(steps: DataFrame) -> DataFrame:
    """``bp, percent``: whole percent of ``steps(bp, status)`` that are settled (a null status is not)."""
    return steps.groupBy("bp").agg(F.floor(F.count("status") * 100 / F.count(F.lit(1))).cast("long").alias("percent"))


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """``bp, text, place``: each text once, in the order first seen. ``warnings(bp, pos, text)``."""
    first = warnings.groupBy("bp", "text").agg(F.min("pos").alias("pos"))
    return first.select("bp", "text", F.row_number().over(Window.partitionBy("bp").orderBy("pos", "text")).alias("place"))


def unique_names(files: DataFrame) -> DataFrame:
    """``owner, pos, name``: later equal names get `` (2)``, `` (3)`` before their extension. ``files(owner, pos, filename)``; names that already look so are not avoided."""
    nth = F.row_number().over(Window.partitionBy("owner", "filename").orderBy("pos"))
    rows = files.withColumn("nth", nth)
    stem, ending = F.regexp_extract("filename", r"\A(.*?)(\.[^.]*)?\z", 1), F.regexp_extract("filename", r"\A(.*?)(\.[^.]*)?\z", 2)
    return rows.select("owner", "pos", F.when(F.col("nth") == 1, F.col("filename")).otherwise(F.concat(stem, F.lit(" ("), F.col("nth").cast("string"), F.lit(")"), ending)).alias("name"))


def count_differences(blueprints: DataFrame, modules: DataFrame) -> DataFrame:
    """``bp, type, expected, actual`` where the blueprint's activities with a builder and the modules built differ in number. ``modules(bp, type)``."""
    want = activities(blueprints).where(~F.col("type").isin(*UNBUILT)).groupBy("bp", "type").agg(F.count(F.lit(1)).alias("expected"))
    have = modules.groupBy("bp", "type").agg(F.count(F.lit(1)).alias("actual"))
    both = want.join(have, ["bp", "type"], "full").fillna(0, ["expected", "actual"])
    return both.where("expected <> actual")


def shape_errors(blueprints: DataFrame, types: tuple[str, ...] = ACTIVITY_TYPES, kinds: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """``bp, path, keyword``: fields that are missing (required), misspelt (pattern), unknown (enum) or empty (minLength), and lists too short (minItems).

    The keywords are checked as expressions over the flattened nodes, each an error of its own.
    """
    errors = lambda rows, checks: rows.select("bp", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("bp", "e.path", "e.keyword")
    out = errors(containers(blueprints), box_checks(F.col, F.col("path"), F.col("ui") < 0))
    out = out.union(errors(activities(blueprints), activity_checks(F.col, F.col("path"), types)))
    return out.union(errors(questions(blueprints), question_checks(F.col, F.col("path"), kinds)))


def _check(path: Column, keyword: str, field: str, test: Column) -> Column:
    return F.when(test, F.struct(F.concat(path, F.lit(f"/{field}")).alias("path"), F.lit(keyword).alias("keyword")))


def box_checks(box: Field, path: Column, is_section: Column) -> list[Column]:
    """``struct<path, keyword>`` of each way a section or subsection can be misshapen, null where it isn't."""
    misspelt = ~F.when(is_section, box("id").rlike(SECTION_ID)).otherwise(box("id").rlike(SUBSECTION_ID))
    missing = [_check(path, "required", c, box(c).isNull()) for c in ("id", "title")]
    return [*missing, _check(path, "pattern", "id", misspelt), _check(path, "minLength", "title", box("title") == ""), _check(path, "minItems", "activities", F.size(box("activities")) == 0)]


def activity_checks(activity: Field, path: Column, types: tuple[str, ...] = ACTIVITY_TYPES) -> list[Column]:
    """As ``box_checks``, of an activity."""
    missing = [_check(path, "required", c, activity(c).isNull()) for c in ("id", "type", "title")]
    return [*missing, _check(path, "pattern", "id", ~activity("id").rlike(ACTIVITY_ID)), _check(path, "enum", "type", ~activity("type").isin(*types)), _check(path, "minLength", "title", activity("title") == "")]


def question_checks(question: Field, path: Column, kinds: tuple[str, ...] = QUESTION_TYPES) -> list[Column]:
    """As ``box_checks``, of a question."""
    choice = question("qtype").isin("multichoice", "truefalse", "shortanswer", "numerical")
    missing = [_check(path, "required", c, question(c).isNull()) for c in ("id", "qtype")]
    return [*missing, _check(path, "pattern", "id", ~question("id").rlike(QUESTION_ID)), _check(path, "enum", "qtype", ~question("qtype").isin(*kinds)), _check(path, "minItems", "answers", choice & (F.size(question("answers")) == 0))]
