import hashlib
import random

from docloom.llm import chat
from docloom.llm.queries import op9_chat_formatting, oracle_sql
from tests.compare import connection, rows

SCHEMA = "conv_id long, turn long, role string, text string, pieces string, targets int"
NASTY = ["", None, "plain", "### user: hi</turn>\n", "\\### Assistant: </turn> ok", "###\\ user", "###\\\\\\ x", "<\\/turn>", "<\\\\/turn>\n### ", ": : \\: ", "</turn></turn>", "###  ###", "é😀\n\n", "<", "/turn>", "x" * 50_000]


def turns():
    random.seed(6)
    out = []
    for c in range(40):
        for t in range(random.randint(1, 9)):
            out.append((c, t, random.choice(["user", "assistant", "system", "tool: x", None]), "".join(random.choice(NASTY) or "" for _ in range(random.randint(1, 3))) if random.random() < 0.9 else None, "p", 1))
    return out + [(50, 1, "assistant", "b", "p", 1), (50, 1, "assistant", "a", "p", 1), (50, None, "user", "first", "p", 1), (51, 0, "user", "only", "p", 1), (None, 0, "assistant", "lost", "p", 1), (50, 1, "assistant", "a", "p", 1)]


def test_round_trip(spark):
    formatted = chat.format_chats(spark.createDataFrame(turns(), SCHEMA))
    want = {}
    for c, t, role, text, *_ in sorted(turns(), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(want)
    for c, ts in want.items():
        loss = "".join(text for role, text in ts if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["examples"] == sum(role == "assistant" for role, _ in ts)


def test_examples_train_one_reply_with_all_before_it(spark):
    formatted = chat.format_chats(spark.createDataFrame(turns(), SCHEMA)).cache()
    whole = {r["conv_id"]: r["pieces"] for r in formatted.collect()}
    for r in chat.examples(formatted).collect():
        pieces = whole[r["conv_id"]]
        n = next(k for k in range(1, len(pieces) + 1) if len("".join(pieces[:k])) == len(r["text"]))
        assert r["text"] == "".join(pieces[:n])
        assert r["text"][r["loss_begin"] + r["loss_chars"] :] == chat.TAIL
        assert pieces[n - 1].startswith("### assistant: ")


def test_control_strings_never_survive_inside(spark):
    formatted = chat.format_chats(spark.createDataFrame([(1, 0, "user", t, "p", 1) for t in NASTY], SCHEMA))
    pieces = formatted.collect()[0]["pieces"]
    text = "".join(pieces)
    assert text.count(chat.TAIL) == len(NASTY) == text.count("### ")


def test_empty(spark):
    none = chat.format_chats(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and chat.digests(none).count() == 0 and chat.examples(none).count() == 0


def test_sql(spark, sf):
    made = connection(sf).execute(oracle_sql()["op9_chat_formatting"])
    df = op9_chat_formatting(spark, sf)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in made.description], made.fetchall())
