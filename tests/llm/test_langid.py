import itertools
import random

import numpy as np

from docloom.llm import langid
from docloom.llm.queries import op8_language_id

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
LETTERS = {"xx": "abcde", "yy": "cdefg", "zz": "aegik"}


def prose(lang, n):
    return " ".join("".join(random.choice(LETTERS[lang]) for _ in range(random.randint(2, 7))) for _ in range(n))


def docs(n=300):
    random.seed(4)
    return [(i, prose(lang := random.choice([*LETTERS]), random.randint(5, 60)), lang, "p", "s") for i in range(n)]


def test_forward_backward_against_every_path():
    rng = np.random.default_rng(0)
    emission, transition = rng.standard_normal((9, 3)), rng.standard_normal((3, 3))
    sizes = np.array([4, 1, 3, 1])
    gamma, expected, log_z = langid.posteriors(emission, sizes, transition)
    want, pairs, total, at = np.zeros_like(emission), np.zeros((3, 3)), 0.0, 0
    for n in sizes:
        paths = [(path, np.exp(sum(emission[at + i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in itertools.pairwise(path)))) for path in itertools.product(range(3), repeat=int(n))]
        z = sum(w for _, w in paths)
        for path, w in paths:
            for i, y in enumerate(path):
                want[at + i, y] += w / z
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w / z
        total += np.log(z)
        at += n
    assert np.allclose(gamma, want) and np.allclose(expected, pairs) and np.isclose(log_z, total)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = docs()
    odd = [(1000, None, "xx", "", ""), (1001, "", "yy", "", ""), (1002, "12 34 ... !", "zz", "", ""), (1003, prose("yy", 30_000), None, "", ""), (None, prose("xx", 30), "xx", "", ""), (7, rows[7][1], rows[7][2], "", "")]
    got = langid.identify(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, *_ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_words_of_code_switched_text():
    random.seed(5)
    model = langid.fit([prose(lang, 60) for lang in LETTERS for _ in range(30)], [lang for lang in LETTERS for _ in range(30)])
    mixed = f"{prose('xx', 20)} {prose('zz', 20)}"
    w = langid.words(mixed)
    gamma = langid.posteriors(w.emissions(model.weights), np.array([len(w)]), model.transition)[0]
    labels = [model.languages[i] for i in gamma.argmax(axis=1)]
    assert labels[:20].count("xx") >= 17 and labels[20:].count("zz") >= 17


def test_nothing_to_learn_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, "", ""), (2, "...", None, "", "")], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}


def test_documents_with_their_language(spark):
    table = spark.createDataFrame(docs(60), SCHEMA)
    model = langid.train(table)
    out = langid.predicted(table, model)
    assert sorted(out.columns) == sorted(table.columns)
    want = {r["doc_id"]: r["lang_pred"] for r in langid.predict(table, model).collect()}
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == want


def test_query(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op8_language_id(spark, sf).where("held_out").collect() if truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def test_marks_stay_in_words_and_words_get_labels(spark):
    assert len(langid.words("हिन्दी में लिखा गया वाक्य")) == 5 and len(langid.words("\u0301\u0301 a\u0301b \u0301")) == 1
    model = langid.fit(["the cat and the dog of the house", "el gato y el perro de la casa"] * 4, ["en", "es"] * 4)
    table = spark.createDataFrame([(1, "the dog y el gato"), (2, None), (3, "12")], "doc_id long, text string")
    got = {r["doc_id"]: [(w["word"], w["lang"]) for w in r["words"]] for r in langid.word_labels(table, model).collect()}
    assert got == {1: [("the", "en"), ("dog", "en"), ("y", "es"), ("el", "es"), ("gato", "es")], 2: [], 3: []}


def test_query_against_plain_forward_backward(spark, sf):
    """Each document's mean posterior by sums over paths of its chains, word by word."""
    import math

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    k, trans = len(model.languages), [[math.exp(x) for x in row] for row in model.transition.tolist()]
    checked = 0
    for r in docs.collect():
        w = langid.words(r["text"] or "")
        if not 0 < len(w) <= 300:
            continue
        e = [[math.exp(x - max(row)) for x in row] for row in w.emissions(model.weights).tolist()]
        total = [0.0] * k
        for at in range(0, len(e), langid.CHAIN):
            chain = e[at : at + langid.CHAIN]
            ahead = [chain[0]]
            for row in chain[1:]:
                new = [sum(ahead[-1][i] * trans[i][j] for i in range(k)) * row[j] for j in range(k)]
                ahead.append([x / sum(new) for x in new])
            behind = [[1.0] * k]
            for row in chain[:0:-1]:
                new = [sum(trans[i][j] * row[j] * behind[-1][j] for j in range(k)) for i in range(k)]
                behind.append([x / sum(new) for x in new])
            for a, b in zip(ahead, behind[::-1], strict=True):
                both = [x * y for x, y in zip(a, b, strict=True)]
                total = [t + x / sum(both) for t, x in zip(total, both, strict=True)]
        best = max(range(k), key=lambda j: total[j])
        assert got[r["doc_id"]][0] == model.languages[best] and abs(got[r["doc_id"]][1] - total[best] / len(e)) < 1e-4
        checked += 1
    assert checked > 50
