"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most ``e`` edits keeps at least one of any
``e + 1`` pieces it is cut into. So the pieces' exact occurrences give every candidate
place, and Myers' bit-parallel recurrence verifies each one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 12
#: Pieces that one pass over the documents holds, in characters.
BLOCK_CHARS = 4_000_000

MATCHES = "doc_id long, text_hash long, item_id long, distance int, budget int, begin int, end int"


def normalized(text: Column) -> Column:
    """Lower case, with one space for every run that has no letter or digit, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def edit_budget(chars: int, chars_per_edit: int) -> int:
    return chars // chars_per_edit


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = len(pattern)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a substring of ``text`` and its first end, if not over ``most``."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


def matches(text: str, items: list[tuple[int, str, int]], automaton) -> Iterator[tuple[int, int, int, int, int]]:
    """``item_id, distance, budget, begin, end`` of each item's best match in a normalized text."""
    places = defaultdict(set)
    for end, (length, owners) in automaton.iter(text):
        for k, offset in owners:
            places[k].add(end + 1 - length - offset)
    for k, starts in places.items():
        item_id, pattern, budget = items[k]
        n, found = len(pattern), None
        exact = [s for s in starts if s >= 0 and text.startswith(pattern, s)]
        if not budget:  # without edits an item is whole words
            exact = [s for s in exact if text[s - 1 : s] in ("", " ") and text[s + n : s + n + 1] in ("", " ")]
        if exact:
            found = (0, min(exact), min(exact) + n)
        elif budget:
            spans: list[list[int]] = []
            for s in sorted(starts):  # windows that overlap are verified at once
                lo, hi = max(0, s - budget), min(len(text), s + n + budget)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                if (got := myers(pattern, text[lo:hi], budget)) and (found is None or got[0] < found[0]):
                    found = (got[0], max(lo, lo + got[1] - n), lo + got[1])
        if found:
            yield item_id, found[0], budget, found[1], found[2]


def _found(documents: DataFrame, benchmark: DataFrame, chars_per_edit: int, block_chars: int) -> DataFrame:
    """``doc_id, text_hash, item_id`` and the match, a row for each item that a row of ``documents`` holds.

    Items go out in blocks of at most ``block_chars`` (or one item): tasks and driver hold one block's
    pieces, and each block is one scan of the documents, so a benchmark of any size is searched whole.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), normalized(F.col("text")).alias("pattern")).where("pattern <> ''").distinct()
    items = materialize(items.withColumn("h", F.xxhash64("item_id", "pattern")), "items")
    total = items.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    texts = documents.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), normalized(F.col("text")).alias("text"))
    found = None
    for block in range(blocks):
        own = items.where(F.pmod("h", F.lit(blocks)) == block).select("item_id", "pattern").collect()
        held = spark.sparkContext.broadcast([(i, p, edit_budget(len(p), chars_per_edit)) for i, p in sorted(map(tuple, own), key=lambda x: (x[0] is None, x))])

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            items, owners = held.value, defaultdict(list)
            for k, (_, pattern, budget) in enumerate(items):
                for offset, piece in pieces(pattern, budget):
                    owners[piece].append((k, offset))
            automaton = ahocorasick.Automaton()
            for piece, at in owners.items():
                automaton.add_word(piece, (len(piece), at))
            automaton.make_automaton()
            for batch in batches:
                rows = [(doc, h, *m) for doc, h, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True) if owners and text for m in matches(text, items, automaton)]
                out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "item_id", "distance", "budget", "begin", "end"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = materialize(texts.mapInPandas(search, MATCHES), "matches")
        held.destroy()
        found = part if found is None else found.union(part)
    forget(items)
    return found


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, budget, begin, end``: one row per document and item that it holds.

    An item is held if its normalized text is within ``length // chars_per_edit`` edits of
    a substring of the document's; ``begin`` and ``end`` place that in the normalized text.
    Null and empty items match nothing, nor do null and empty documents. Items shorter than
    one edit's worth must occur exactly, as whole words. Repeated rows count once, with the least distance, then
    place. A null doc_id is kept as a key of its own. Whole texts are searched. An empty table gives no rows.
    """
    best = F.min(F.struct("distance", "begin", "end", "budget")).alias("m")
    found = _found(documents, benchmark, chars_per_edit, block_chars).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "m.distance", "m.budget", "m.begin", "m.end")


def decontaminate(documents: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``documents`` that hold no item, with or without a doc_id; of an id with several texts those that hold none stay."""
    held = _found(documents, benchmark, chars_per_edit, block_chars).select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    row = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row_"), F.col("doc_id").cast("long").alias("own_"), _text_hash().alias("text_hash_"))
    return row.join(held, (F.col("text_hash_") == F.col("hash_")) & F.col("own_").eqNullSafe(F.col("id_")), "left_anti").select("row_.*")
