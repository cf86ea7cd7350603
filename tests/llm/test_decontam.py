import random
import re

from docloom.llm import decontam


def normal(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def distance(pattern, text):
    """Least edit distance of the pattern to any substring, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def held(pattern, text):
    """The distance of an item that a text holds: within its edits anywhere, or, if it has none, as whole words; else None."""
    if len(pattern) < 12:
        return 0 if f" {pattern} " in f" {text} " else None
    e = distance(pattern, text)
    return e if e <= len(pattern) // 12 else None


def edited(text, n):
    for _ in range(n):
        at = random.randrange(len(text))
        text = random.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


def tables():
    random.seed(8)
    word = lambda: "".join(random.choice("abcde") for _ in range(random.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(random.randint(3, 25))) for i in range(12)] + [(20, None), (21, ""), (22, "…"), (23, "ab"), (24, "Ünïcode Wörds, more of them; and more"), (25, "x" * 40)]
    docs = [(i, prose(random.randint(5, 60))) for i in range(15)]
    for i in range(25):
        k, text = random.choice(items[:12])
        docs.append((100 + i, f"{prose(10)}. {edited(text, random.choice([0, 1, 2, 3, 6]))}, {prose(8)}"))
    docs += [(200, None), (201, ""), (202, items[0][1]), (203, f"{items[1][1]} {edited(items[1][1], 1)}"), (204, "ünïcode wörds more OF them and more"), (205, "x" * 30_000), (206, "x" * 38 + "yz"), (207, "drab cab"), (208, "cab, AB. cab")]
    return docs, items


def test_matches_against_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    want = {}
    for i, t in docs:
        for k, p in items:
            p, text = normal(p), normal(t)
            if p and len(text) < 5000 and (e := held(p, text)) is not None:
                want[i, k] = e
    want[205, 25] = 0
    for options in ({}, {"block_chars": 200}):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_contamination(d, b, **options).collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_rows_without_id_and_ids_of_several_texts(spark):
    docs = spark.createDataFrame([(None, "say quick brown fox now", 1), (None, "clean", 2), (4, "quick brown fox", 3), (4, "clean too", 4), (5, "concatenate", 5)], "doc_id long, text string, id_ int")
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "cat")], "item_id long, text string")
    assert sorted(r["id_"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 4, 5]


def test_places():
    pattern, text = "hello world again", "say helo world again now"
    got = decontam.myers(pattern, text, 3)
    assert got is not None and got[0] == 1 and text[: got[1]].endswith("again")


def test_empty_and_repeats(spark):
    docs, bench = "doc_id long, text string", "item_id long, text string"
    none = spark.createDataFrame([], docs)
    some = spark.createDataFrame([(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, "the quick brown fox jumps over"), (3, "clean")], docs)
    item = spark.createDataFrame([(5, "quick brown fox"), (5, "quick brown fox")], bench)
    assert decontam.find_contamination(none, item).count() == 0
    assert decontam.find_contamination(some, spark.createDataFrame([], bench)).count() == 0
    assert decontam.decontaminate(some, spark.createDataFrame([], bench)).count() == 4
    assert sorted((str(r[0]), r[1], r[2]) for r in decontam.find_contamination(some, item).collect()) == [("1", 5, 0), ("None", 5, 0)]
