import random

from docloom.llm import toxicity
from docloom.llm.queries import op5_toxicity


def docs_and_labels(n=400):
    random.seed(1)
    word = lambda letters: "".join(random.choice(letters) for _ in range(random.randint(3, 7)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [word("abcdefgh") for _ in range(30)] + ([word("xyzw") for _ in range(5)] if bad else [])
        random.shuffle(words)
        docs.append((i, " ".join(words), 9.5, "c"))
        labels.append((i, int(bad), "t"))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score double, toxic string", "doc_id long, toxic int, text string"


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = docs_and_labels()
    odd = [(1000, None, 0.0, "c"), (1001, "", 0.0, "c"), (1002, f"{docs[0][1]} " * 300, 0.0, "c"), (None, "abc", 0.0, "c"), (5, docs[5][1], 0.0, "c")]
    more = [(None, 1, "t"), (7, None, "t"), (9, 5, "t"), (1000, 0, "t"), (0, 0, "t")]
    rows = toxicity.classify(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS)).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert by[1000]["score"] == by[1001]["score"] and by[1002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_score_does_not_see_the_label_of_a_held_out_row(spark):
    docs, labels = docs_and_labels(200)
    d = spark.createDataFrame(docs, DOCS)
    first = {r["doc_id"]: r["score"] for r in toxicity.classify(d, spark.createDataFrame(labels, LABELS)).collect()}
    held = {r["doc_id"] for r in toxicity.classify(d, spark.createDataFrame(labels, LABELS)).where("held_out").collect()}
    flipped = [(i, 1 - t if i in held else t, x) for i, t, x in labels]
    assert first == {r["doc_id"]: r["score"] for r in toxicity.classify(d, spark.createDataFrame(flipped, LABELS)).collect()}


def test_no_labels_one_class_and_empty(spark):
    docs, labels = docs_and_labels(40)
    d = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.classify(d, none).collect()} == {0}
    assert {r["predicted"] for r in toxicity.classify(d, spark.createDataFrame([(i, 1, "t") for i, _, _ in labels], LABELS)).collect()} == {1}
    assert toxicity.classify(spark.createDataFrame([], DOCS), none).count() == 0


def test_query_ranks_held_out_toxic_documents_first(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]]) for r in op5_toxicity(spark, sf).where("held_out").collect() if truth.get(r["doc_id"]) is not None]
    pos, neg = [s for s, t in rows if t == 1], [s for s, t in rows if t == 0]
    assert pos and neg
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.85


def test_against_a_plain_classifier(spark):
    """Counts, ratios, the fit's steps and the scores with dictionaries, n-gram by n-gram."""
    import math
    import random
    import zlib

    random.seed(5)
    bad, good = ["vile", "rotten", "nasty"], ["kind", "sunny", "gentle"]
    rows = [(i, " ".join(random.choice((bad if i % 3 == 0 else good) + ["table", "river", "stone"]) for _ in range(12)), int(i % 3 == 0)) for i in range(60)] + [(100, "", 0), (101, None, 0)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}

    def grams(text):
        t = f" {(text or '').lower()} "
        return {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}

    learned = [(grams(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    n1 = sum(y for _, y in learned)
    n0 = len(learned) - n1
    ratio = {}
    for g in set().union(*(x for x, _ in learned)):
        a, b = sum(g in x for x, y in learned if y), sum(g in x for x, y in learned if not y)
        r = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n0 + 2))
        if a + b >= 3 and abs(r) >= 1:
            ratio[g] = r
    names = sorted(ratio)
    rows_ = [([g for g in names if g in x], y, 0.5 / (n1 if y else n0)) for x, y in learned]

    def times(w, bias):
        return [sum(w[g] * ratio[g] for g in x) + bias for x, _, _ in rows_]

    def back(z):
        out = dict.fromkeys(names, 0.0)
        for (x, _, _), v in zip(rows_, z, strict=True):
            for g in x:
                out[g] += v * ratio[g]
        return out, sum(z)

    top, bias, curve = dict.fromkeys(names, 1.0), 1.0, 1.0
    for _ in range(12):
        top, bias = back([m * c / 4 for m, (_, _, c) in zip(times(top, bias), rows_, strict=True)])
        curve = math.sqrt(sum(v * v for v in top.values()) + bias * bias)
        top, bias = {g: v / curve for g, v in top.items()}, bias / curve
    step = 1 / (1.1 * curve + toxicity.RIDGE)
    w, b, ahead, ab, t = dict.fromkeys(names, 0.0), 0.0, dict.fromkeys(names, 0.0), 0.0, 1.0
    for _ in range(toxicity.ROUNDS):
        grad, gb = back([(1 / (1 + math.exp(-m)) - y) * c for m, (_, y, c) in zip(times(ahead, ab), rows_, strict=True)])
        new, nb = {g: ahead[g] - step * (grad[g] + toxicity.RIDGE * ahead[g]) for g in names}, ab - step * gb
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ab = {g: new[g] + (t - 1) / s * (new[g] - w[g]) for g in names}, nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    for i, text, _ in rows:
        z = b + sum(w[g] * ratio[g] for g in grams(text) if g in ratio)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-3, i
