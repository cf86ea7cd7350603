import random
import re

from docloom.llm import mixing
from docloom.llm.queries import op6_mixing, oracle_sql
from tests.compare import connection, rows

SCHEMA = "doc_id long, text string, source string, size string, position int"


def docs():
    random.seed(2)
    out = [(i, " ".join("w" * random.randint(1, 5) for _ in range(random.randint(0, 60))), random.choice("aaaaabc"), "x", 1) for i in range(400)]
    return out + [(900, None, None, "x", 1), (901, "one\ttwo\nthree", None, "x", 1), (902, "", "d", "x", 1), (None, "lost id here", "a", "x", 1), (3, out[3][1], out[3][2], "x", 1), (903, "v " * 9000, "b", "x", 1)]


def wanted(sizes):
    """Targets by sharing out what is over again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_takes(spark):
    table = spark.createDataFrame(docs(), SCHEMA)
    got = mixing.mix(table).collect()
    assert len(got) == len(docs())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in docs():
        sizes[s] = sizes.get(s, 0) + size(t)
    target = wanted(sizes)
    by_size = {}
    for r in got:
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    assert sorted(by_size) == sorted({(sizes[s], round(target[s], 6)) for s in sizes})
    for (_, goal), rs in by_size.items():
        assert abs(sum(r["taken"] for r in rs) - goal) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))


def test_positions_follow_the_schedule(spark):
    """The integral of the linear weight up to a position is the share of demand met."""
    from pyspark.sql import functions as F

    cases = [(share, start, end) for start, end in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)) for share in (0.0, 0.1, 0.5, 0.9, 1.0)]
    got = spark.createDataFrame(cases, "share double, a double, b double").select("*", mixing.position(F.col("share"), F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        assert abs(r["a"] * r["x"] + (r["b"] - r["a"]) * r["x"] ** 2 / 2 - r["share"] * (r["a"] + r["b"]) / 2) < 1e-12


def test_every_pass_has_its_own_position(spark):
    for r in mixing.mix(spark.createDataFrame(docs(), SCHEMA)).collect():
        assert len(r["positions"]) == r["copies"] and r["positions"] == sorted(set(r["positions"])) and (not r["copies"] or r["position"] == r["positions"][0])


def test_rows_without_ids_are_taken_apart(spark):
    table = spark.createDataFrame([(None, f"w{i} " * 10, "a", i) for i in range(100)] + [(1, "x " * 200, "b", 0)], "doc_id long, text string, source string, last int")
    plan = sum(r["copies"] for r in mixing.mix(table).collect())
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns and out.count() == plan


def test_documents_as_often_as_taken(spark):
    table = spark.createDataFrame(docs(), SCHEMA)
    plan = {}
    for r in mixing.mix(table).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    # equal ids share a hash, so both rows of the repeated id go together
    assert {k: v for k, v in got.items() if k != 3} == {k: v for k, v in plan.items() if v and k != 3}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_sql(spark, sf):
    made = connection(sf).execute(oracle_sql()["op6_mixing"])
    df = op6_mixing(spark, sf)
    names = [d[0] for d in made.description]
    assert rows(names, [tuple(r[n] for n in names) for r in df.collect()]) == rows(names, made.fetchall())
