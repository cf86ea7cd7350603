from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import langid, mixing, sharding
from tests.llm.test_decontam import held, normal
from tests.llm.test_simhash import classes, plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, None, None, 0), (90_001, "", "en", "s", 0), (90_002, "12 ... 3", "en", "s", 8), (None, "quite another text without any id", "en", "s", 33)], SCHEMA)
    docs = docs.unionByName(odd)
    rows = docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    known = stage["language_id"](spark, docs, sf)
    want = Counter(r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or ""))
    assert Counter(r["doc_id"] for r in known.collect()) == want and known.columns == docs.columns

    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    component = classes({i: plain(t) for i, t in texts.items()})
    single = stage["simhash_near_dedup"](spark, docs.where("doc_id is not null"), sf)
    assert {r["doc_id"] for r in single.collect()} == set(component.values())

    items = [normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    few = [r["doc_id"] for r in rows if r["text"] and len(r["text"]) < 1500][:40]
    clean = {r["doc_id"] for r in stage["benchmark_decontamination"](spark, docs, sf).collect()}
    for i in few:
        text = normal(texts[i]) if i is not None else ""
        if text:
            assert (i in clean) == all(not p or held(p, text) is None for p in items)

    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    mixed = stage["mixing"](spark, docs, sf)
    assert Counter(r["doc_id"] for r in mixed.collect()) == +plan and mixed.columns == docs.columns

    sharded = stage["sharding"](spark, docs, sf)
    assert Counter((r["doc_id"], r["shard"]) for r in sharded.collect()) == Counter((r["doc_id"], r["shard"]) for r in sharding.shard(docs).collect())


def test_language_stage_by_score_and_without_a_model(spark, sf):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    odd = spark.createDataFrame([(90_003, "съешь ещё этих мягких французских булок " * 9, None, "s", 8), (90_004, "123 ...", None, "s", 8)], SCHEMA)
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd)
    scores = langid.identify(docs).collect()
    got = Counter(r["doc_id"] for r in stage(spark, docs, sf).collect())
    assert got == Counter(r["doc_id"] for r in scores if r["score"] >= corpus_pipeline.LEAST_SCORE) and not {90_003, 90_004} & set(got)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in stage(spark, unlabelled, sf).collect()} == want


def test_mixing_stage_writes_in_training_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    positions = {r["doc_id"]: r["positions"] for r in mixing.mix(docs).collect()}
    dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    order = [r["doc_id"] for f in sorted((tmp_path / "mixed").glob("part-*.parquet")) for r in spark.read.parquet(str(f)).select("doc_id").coalesce(1).collect()]
    seen, line = Counter(), []
    for i in order:
        line.append(positions[i][seen[i]])
        seen[i] += 1
    assert line == sorted(line) and len(line) == sum(map(len, positions.values())) and max(seen.values()) == 2


def test_stages_on_empty_tables_and_clashing_columns(spark, sf):
    names = "h, part, s, last, copy, size, tie, position, fp, text_hash, component, rank, row_, id_, hash_, g, d, pieces, alone, item, lang_pred, score".split(", ")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0, name
        wide = docs.withColumns({n: F.lit(f"own {n}") for n in names})
        got = stage(spark, wide, sf)
        assert [c for c in got.columns if c != "shard"] == wide.columns, name
        assert all(r[n] == f"own {n}" for r in got.select(*names).collect() for n in names), name


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "shard"]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = out.collect()
    assert got and {r["doc_id"] for r in got} <= ids
    assert max(Counter(r["doc_id"] for r in got).values()) <= mixing.MOST_PASSES
