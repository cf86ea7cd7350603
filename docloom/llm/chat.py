"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before it are its
context, only its text is trainable. A conversation is formatted turn by turn first; an
example's text is the turns up to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is HEAD role BREAK text TAIL.
HEAD, BREAK, TAIL = "### ", ": ", "</turn>\n"
#: Marks inside a text get a backslash after these characters, and one more where they have some already.
MARKS = (("###", " "), ("<", "/turn>"))
ROLE_MARKS = (*MARKS, (":", " "))


def escape(text: Column, marks: tuple[tuple[str, str], ...] = MARKS) -> Column:
    for left, right in marks:
        text = F.regexp_replace(text, rf"{left}(\\*){right}", rf"{left}\\$1{right}")
    return text


def unescape(text: Column, marks: tuple[tuple[str, str], ...] = MARKS) -> Column:
    for left, right in marks:
        text = F.regexp_replace(text, rf"{left}\\(\\*){right}", rf"{left}$1{right}")
    return text


def format_chats(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``conv_id, pieces, targets``: one row per conversation of ``conversations(conv_id, turn, role, text)``.

    ``pieces``: the formatted turns in order of turn; ties by role, then text, nulls first.
    ``targets``: one struct for each example, in order: ``piece`` (its index from 0),
    ``begin`` (characters of that piece before the trainable text) and ``chars``.
    Null texts and roles are empty; a null conv_id is one conversation. Conversations
    without the target role have no targets but keep their pieces. Repeated rows are
    turns of their own. An empty table gives no rows.

    Turns are gathered per conversation, so a value is as large as its conversation; an example is
    one string, so 2 GB is the format's bound.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(HEAD), escape(t["role"], ROLE_MARKS), F.lit(BREAK), escape(t["text"]), F.lit(TAIL))
    begin = len(HEAD) + len(BREAK)
    span = lambda t, i: F.when(t["role"] == target_role, F.struct(i.alias("piece"), (F.length(escape(t["role"], ROLE_MARKS)) + begin).alias("begin"), F.length(escape(t["text"])).alias("chars")))
    return turns.select("conv_id", F.transform("turns", piece).alias("pieces"), F.array_compact(F.transform("turns", span)).alias("targets"))


def read_turns(pieces: Column) -> Column:
    """The turns (role, text) that formatted pieces hold."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(HEAD) + 1), F.length(piece) - len(HEAD) - len(TAIL))
        at = F.instr(body, BREAK)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), ROLE_MARKS).alias("role"), unescape(F.substr(body, at + len(BREAK))).alias("text"))

    return F.transform(pieces, turn)


def examples(formatted: DataFrame, rest: bool = False) -> DataFrame:
    """``conv_id, example, text, loss_begin, loss_chars``: one row per target with all turns before it as context.

    ``rest`` adds a row for each conversation with its whole text, a null ``example`` and nothing under the loss
    mask: the turns behind the last target, and conversations without one, are in no example.
    Contexts are spelled out, so a conversation of n turns gives some n * n / 2 turns of text, one example a row.
    """
    last = F.array(F.struct((F.size("pieces") - 1).alias("piece"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("chars")))
    each = formatted.select("conv_id", "pieces", F.size("targets").alias("n"), F.posexplode(F.concat("targets", last) if rest else F.col("targets")).alias("at", "t"))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("t.piece")), "")
    text = F.concat(before, F.get("pieces", F.col("t.piece")))
    return each.select(
        "conv_id", F.when(F.col("at") < F.col("n"), F.col("at")).alias("example"), text.alias("text"),
        (F.length(before) + F.col("t.begin")).cast("long").alias("loss_begin"), F.coalesce("t.chars", F.lit(0)).cast("long").alias("loss_chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the exploded examples give back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, examples, contexts_sha256``.

    Each example is read back from its text alone: its turns by the marks, its reply by the loss mask.
    ``contexts_sha256`` digests the digests of all turns that each example holds, in order.
    A null conv_id is a conversation as any other.
    """
    pieces = F.transform(F.filter(F.split("text", TAIL, -1), lambda p: p != ""), lambda p: F.concat(p, F.lit(TAIL)))
    reply = F.when(F.col("example").isNotNull(), unescape(F.expr("substr(text, loss_begin + 1, loss_chars)")))
    read = examples(formatted, rest=True).select("conv_id", "example", F.length("text").cast("long").alias("chars"), reply.alias("reply"), read_turns(pieces).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "example", "reply", "chars", F.size("turns").cast("long").alias("n"), F.sha2(lines, 256).alias("sha"))
    whole = F.max(F.when(F.col("example").isNull(), F.struct("chars", "n", "sha")))
    kept = F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "reply", "sha"))))
    out = read.groupBy("conv_id").agg(whole.alias("w"), kept.alias("e")).withColumn("loss", F.array_join("e.reply", ""))
    return out.select(
        "conv_id", F.col("w.n").alias("n_turns"), F.col("w.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("w.chars").alias("formatted_chars"), F.size("e").cast("long").alias("examples"), F.sha2(F.array_join("e.sha", ""), 256).alias("contexts_sha256"),
    )


def oracle_sql() -> str:
    """``digests`` of all conversations and conversation -7 as DuckDB SQL."""
    escapes = lambda of, marks: " + ".join(f"len(regexp_extract_all({of}, '{left}\\\\*{right}'))" for left, right in marks)
    marks = len(HEAD) + len(BREAK) + len(TAIL)
    return f"""
    with rows as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    held as (
        select *, sha256(string_agg(role || chr(10) || text || chr(10), '') over (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row)) as context
        from rows),
    per as (
        select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
            coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
            coalesce(string_agg(context, '' order by turn nulls first, role, text, context) filter (role = 'assistant'), '') as contexts,
            sum(length(role) + length(text) + {escapes('role', ROLE_MARKS)} + {escapes('text', MARKS)} + {marks})::bigint as formatted_chars,
            count(*) filter (role = 'assistant') as examples
        from held group by conv_id)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, examples, sha256(contexts) as contexts_sha256 from per"""
