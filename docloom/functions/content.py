"""Shaping of course content: dates, completion rules, answers, options and question markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_name, strip

MAX_ANSWERS = 20


def midnight(date: Column) -> Column:
    """Epoch seconds of a ``YYYY-MM-DD`` that is in the calendar, else null."""
    shaped = F.when(date.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), date)
    return F.unix_timestamp(F.try_to_date(shaped, "yyyy-MM-dd").cast("timestamp"))


def completion(mode: Column, view: Column, usegrade: Column, passgrade: Column, rules: Column, quiz: bool = False) -> Column:
    """``tracking`` (0 none, 1 manual, 2 automatic) and, if automatic, the flags and rules that count; a quiz's pass grade needs a grade."""
    tracking = F.when(mode == "auto", 2).when(mode == "manual", 1).otherwise(0)
    auto = tracking == 2
    flag = lambda c: F.when(auto & c.isNotNull(), c.cast("int"))
    if quiz:
        view, usegrade, passgrade = (F.coalesce(c, F.lit(False)) for c in (view, usegrade, passgrade))
        usegrade = usegrade | passgrade
    kept = F.map_filter(rules, lambda k, v: k.rlike(r"\Acompletion[a-z]+\z"))
    return F.struct(tracking.alias("tracking"), flag(view).alias("view"), flag(usegrade).alias("usegrade"), flag(passgrade).alias("passgrade"), F.when(auto, kept).alias("rules"))


def options(texts: Column) -> Column:
    """Cleaned choice options without blank ones."""
    return F.filter(F.transform(texts, lambda t: clean_name(t)), lambda t: t != "")


def lesson_answers(answers: Column, kind: Column) -> Column:
    """Answers (structs with ``text``) that aren't blank, at most 20, of true or false questions 2."""
    kept = F.filter(answers, lambda a: strip(F.regexp_replace(F.coalesce(a["text"], F.lit("")), r"<[^>]*>", "")) != "")
    return F.slice(kept, F.lit(1), F.when(kind == "truefalse", 2).otherwise(MAX_ANSWERS))


def lesson_score(score: Column, jump: Column, place: Column, places: Column) -> Column:
    """The given score, else 1 if the jump goes on: to the next page, the end, a later page or an unknown one. ``places``: map of page ids."""
    jump = F.coalesce(jump, F.lit("next"))
    to = F.try_element_at(places, jump)
    return F.coalesce(score, F.when(jump == "this", 0).when(to.isNotNull(), (to > place).cast("int")).otherwise(1))


def lesson_jump(jump: Column, pages: Column) -> Column:
    """What a jump is stored as: -9 the end, 0 this page, -1 the next one (also for unknown pages), else the page's id. ``pages``: map of ids."""
    return F.when(jump == "end", -9).when(jump == "this", 0).when(jump == "next", -1).otherwise(F.coalesce(F.try_element_at(pages, jump), F.lit(-1)))


def number(value: Column) -> Column:
    """At most seven decimals without zeros at the end."""
    fixed = F.rtrim(F.format_string("%.7f", value), F.lit("0"))
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(F.rtrim(fixed, F.lit(".")))


def cdata(text: Column) -> Column:
    """A text in CDATA; the mark that ends a section is split over two."""
    return F.concat(F.lit("<text><![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></text>"))


def question_xml(qtype: Column, name: Column, text: Column, answers: Column) -> Column:
    """A question with its answers (structs ``text``, ``fraction``); null for kinds that can't be written."""
    answer = lambda a: F.concat(F.lit('<answer fraction="'), number(a["fraction"] * 100), F.lit('">'), cdata(a["text"]), F.lit("</answer>"))
    whole = F.concat(F.lit('<question type="'), qtype, F.lit('"><name>'), cdata(clean_name(name)), F.lit("</name><questiontext>"), cdata(text), F.lit("</questiontext>"), F.array_join(F.transform(answers, answer), ""), F.lit("</question>"))
    return F.when(qtype != "multianswer", whole)
