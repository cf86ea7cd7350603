import re

from docloom.operators import chunking as C
from docloom.operators import structure as S
from docloom.plans.text import paged

SCHEMA = "doc_id long, text string"


def chunks(spark, text):
    return [r.asDict() for r in C.chunks(spark.createDataFrame([(1, text)], SCHEMA)).orderBy("chunkindex").collect()]


def words(n, first=0):
    return " ".join(f"word{first + i}" for i in range(n))


def test_small_text_is_one_chunk(spark):
    (c,) = chunks(spark, "<!-- page 3 -->\n# Title\n\nSome text.\n\n<!-- page 4 -->\nMore.")
    assert (c["title"], c["pagefrom"], c["pageto"], c["content"]) == ("Title", 3, 4, "# Title\n\nSome text.\n\nMore.")
    assert chunks(spark, "") == [] and chunks(spark, "<!-- page 1 -->\n\n") == []


def test_cut_before_a_heading_has_no_overlap(spark):
    text = f"# One\n\n{words(700)}\n\n## Two\n\n{words(700, 1000)}"
    a, b = chunks(spark, text)
    assert a["title"] == "One" and b["title"] == "Two" and b["content"].startswith("## Two")


def test_cut_by_size_repeats_the_end(spark):
    sentences = [f"Sentence {i} says {words(8)}." for i in range(400)]
    text = "\n\n".join(" ".join(sentences[i : i + 10]) for i in range(0, 400, 10))
    got = chunks(spark, text)
    assert len(got) > 1
    for a, b in zip(got, got[1:], strict=False):
        head = b["content"].split("\n\n")[0]
        assert head in a["content"]
        assert C.count(head) <= 0.1 * a["tokencount"] + 1


def test_headings_go_with_what_they_introduce(spark):
    text = "\n\n".join([words(400), words(400, 400), words(350, 800), "### Deep", words(500, 2000)])
    got = chunks(spark, text)
    assert not got[0]["content"].endswith("### Deep") and any("### Deep\n\nword2000" in c["content"] for c in got)


def test_oversized_paragraph_table_and_word(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {words(6)} |" for i in range(400))
    for text in (words(3000), table, "x" * 40_000):
        got = chunks(spark, text)
        assert len(got) > 1 and all(c["tokencount"] <= 3000 * 1.11 for c in got)
    assert all("| a | b |" in c["content"] for c in chunks(spark, table))


def test_invariants_over_documents(spark, sf):
    text = S.normalized(paged(spark, sf)).cache()
    made = {}
    for r in C.chunks(text).collect():
        made.setdefault(r["doc_id"], []).append(r)
    for r in text.collect():
        got = sorted(made.get(r["doc_id"], []), key=lambda c: c["chunkindex"])
        assert [c["chunkindex"] for c in got] == list(range(len(got)))
        own = set(re.findall(r"\w+", re.sub(r"(?m)^<!-- page \d+ -->$", "", r["text"])))
        assert own <= {w for c in got for w in re.findall(r"\w+", c["content"])}
        assert all(c["tokencount"] == C.count(c["content"]) and c["tokencount"] <= 3000 * 1.11 for c in got)
        pages = [c["pagefrom"] for c in got if c["pagefrom"] is not None]
        assert pages == sorted(pages)
