"""Language identification with a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon (whole word) features, hashed into one
weight table with a column for each language; transition weights between the languages of
neighbouring words are learned with them. Forward-backward gives each word's posterior;
a document's languages are its words' mean posteriors.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import in_fold
from .ngrams import code_points

BITS = 17
#: Documents of each language that the model is fitted on, at most.
MAX_TRAIN_ROWS = 150
#: Words in a chain: longer texts are cut into consecutive chains, all of which count.
CHAIN, PIECE, TRAIN_CHAIN = 128, 16, 64
ROUNDS, RATE, RIDGE = 25, 0.5, 1e-6
UNKNOWN = "und"
AFFIXES = 6


@cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for the marks that combine with them, else 0."""
    kind = unicodedata.category
    return np.fromiter(({"L": 1, "M": 2}.get(kind(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Words:
    """Feature buckets of the words of some texts: ``fixed`` has one row per word, ``grams`` those of each word from ``first`` on."""

    fixed: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.fixed)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(weights[self.grams], self.first, axis=0) if len(self) else np.zeros((0, weights.shape[1]), weights.dtype)
        for column in self.fixed.T:
            out += weights[column]
        return out


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased code points, spaces for all that isn't in a word, and where words start and end in them."""
    cps = np.concatenate([[np.uint32(32)], code_points(text.lower()), [np.uint32(32)]]).astype(np.uint32)
    kind = _kinds()[cps]
    inside = kind > 0
    if (kind == 2).any():  # marks before a run's first letter are not in a word
        inside &= np.cumsum(kind == 1) > np.maximum.accumulate(np.where(inside, 0, np.cumsum(kind == 1)))
    cps = np.where(inside, cps, np.uint32(32))
    edge = np.diff(inside.astype(np.int8))
    return cps, np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def words(text: str) -> Words:
    """A word is a letter with the letters and marks that follow it, lower-cased."""
    cps, start, end = spans(text)
    letter = cps != 32
    if not len(start):
        return Words(np.empty((0, AFFIXES + 1), np.uint32), np.empty(0, np.uint32), start)
    size = end - start
    fixed = np.empty((len(start), AFFIXES + 1), np.uint32)
    for side in (0, 1):
        h = np.zeros(len(start), np.uint32)
        for k in range(3):
            at = np.minimum(start + k, end) if side == 0 else np.maximum(end - 1 - k, start - 1)
            h = h * np.uint32(0x01000193) ^ cps[at]
            fixed[:, 3 * side + k] = _mix(h, 1 + 3 * side + k)
    inside = np.flatnonzero(letter)
    place = inside - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), 0x01000193, np.uint32), dtype=np.uint32)
    fixed[:, AFFIXES] = _mix(np.add.reduceat(cps[inside] * power[place], np.cumsum(size) - size, dtype=np.uint32), 7)
    # the trigrams around each letter, with a space at either side of a word
    h = (cps[inside - 1] * np.uint32(0x9E3779B1)) ^ (cps[inside] * np.uint32(0xC2B2AE3D)) ^ (cps[inside + 1] * np.uint32(0x27D4EB2F))
    return Words(fixed, _mix(h, 8), np.cumsum(size) - size)


def join(parts: list[Words]) -> Words:
    offsets = np.cumsum([0, *(len(p.grams) for p in parts)])[:-1]
    return Words(np.concatenate([p.fixed for p in parts]), np.concatenate([p.grams for p in parts]), np.concatenate([p.first + o for p, o in zip(parts, offsets, strict=True)]))


def chains(counts: np.ndarray, length: int) -> np.ndarray:
    """Sizes of the consecutive chains that runs of ``counts`` words are cut into."""
    return np.concatenate([np.empty(0, np.int64), *(np.append(np.full(n // length, length), [n % length] if n % length else []) for n in counts.tolist())]).astype(np.int64)


def posteriors(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains: word posteriors, expected transitions and the log partition function's sum."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    lengths, labels = sizes[order], emission.shape[1]
    steps = int(lengths[0]) if len(lengths) else 0
    top = emission.max(axis=1, keepdims=True)
    e = np.exp(emission - top)
    a = np.exp(transition)
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # chains with a word at each step
    for t in range(steps):
        at = begin[: alive[t]] + t
        now = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        scale[at] = now.sum(axis=1)
        alpha[at] = now / scale[at][:, None]
    beta = np.ones_like(e)
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        later = beta[at + 1] * e[at + 1] / scale[at + 1][:, None]
        beta[at] = later @ a.T
        expected += (alpha[at].T @ later) * a
    return alpha * beta, expected, float(np.log(scale).sum() + top.sum())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transition: np.ndarray

    def predict(self, texts: list[str | None], most_words: int = 200_000) -> Iterator[tuple[str, float]]:
        """Language and its mean posterior for each text, some texts at once."""
        at = 0
        while at < len(texts):
            parts, held = [], 0
            while at < len(texts) and (not parts or held < most_words):
                parts.append(words(texts[at] or ""))
                held += len(parts[-1])
                at += 1
            yield from self._predict(parts)

    def label(self, text: str | None) -> list[tuple[str, str, float]]:
        """Each word of a text, in order, with its language and posterior; none if nothing was learned."""
        cps, start, end = spans(text or "")
        if not self.languages or not len(start):
            return []
        gamma = posteriors(words(text or "").emissions(self.weights), chains(np.array([len(start)]), CHAIN), self.transition)[0]
        best = gamma.argmax(axis=1)
        written = ["".join(map(chr, cps[a:b].tolist())) for a, b in zip(start, end, strict=True)]
        return [(w, self.languages[k], float(min(1.0, g))) for w, k, g in zip(written, best.tolist(), gamma.max(axis=1).tolist(), strict=True)]

    def _predict(self, parts: list[Words]) -> Iterator[tuple[str, float]]:
        counts = np.array([len(p) for p in parts])
        if not self.languages or not counts.sum():
            yield from ((UNKNOWN, 0.0) for _ in parts)
            return
        emission = join([p for p in parts if len(p)]).emissions(self.weights)
        gamma = posteriors(emission, chains(counts, CHAIN), self.transition)[0]
        mean = np.add.reduceat(gamma, (np.cumsum(counts) - counts)[counts > 0], axis=0) / counts[counts > 0][:, None]
        found = iter(mean)
        for n in counts:
            if not n:
                yield UNKNOWN, 0.0
            else:
                p = next(found)
                yield self.languages[int(p.argmax())], float(min(1.0, p.max()))


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Model:
    """Maximum likelihood by adaptive gradient steps on chains spliced from pieces of different texts, so that languages switch in them."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    parts = [words(t or "") for t in texts]
    counts = np.array([len(p) for p in parts])
    if not counts.sum():
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    label = np.repeat([names.index(x) for x in langs], counts)
    every = join([p for p in parts if len(p)])
    pieces = chains(counts, PIECE)
    begin = np.cumsum(pieces) - pieces
    dealt = np.random.default_rng(11).permutation(len(pieces))
    order = np.concatenate([np.arange(begin[i], begin[i] + pieces[i]) for i in dealt])
    sizes = chains(np.array([len(order)]), TRAIN_CHAIN)
    y = label[order]
    heads = np.cumsum(sizes) - sizes
    inner = np.ones(len(y), bool)
    inner[heads] = False
    k = len(names)
    observed = np.zeros((k, k))
    np.add.at(observed, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    owner = np.repeat(np.arange(len(every)), np.diff(np.append(every.first, len(every.grams))))
    weights, transition = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    for _ in range(rounds):
        gamma, expected, _ = posteriors(every.emissions(weights)[order], sizes, transition)
        gamma[np.arange(len(y)), y] -= 1
        err = np.empty_like(gamma)
        err[order] = gamma / len(y)
        for c in range(k):
            e = err[:, c]
            g = np.bincount(every.grams, e[owner], 1 << BITS) + RIDGE * weights[:, c]
            for column in every.fixed.T:
                g += np.bincount(column, e, 1 << BITS)
            seen_w[:, c] += g * g
            weights[:, c] -= RATE * g / np.sqrt(seen_w[:, c])
        g = (expected - observed) / len(y)
        seen_t += g * g
        transition -= RATE * g / np.sqrt(seen_t)
    return Model(names, weights.astype(np.float32), transition)


def train(documents: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on ``text`` and ``lang`` outside the held-out fold: by hash of the id, at most ``max_rows`` documents of each language.

    The ranks keep ``max_rows`` ids of each language and task before they shuffle; only the
    sampled ids meet the texts, and their rows, which the parameter bounds, go to one task.
    """
    known = documents.where("lang is not null and text is not null and doc_id is not null").where(~in_fold(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long"), F.col("lang").alias("learned"))
    rank = F.row_number().over(Window.partitionBy("learned").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = known.withColumn("rank", rank).where(F.col("rank") <= max_rows).select("doc_id", "learned").distinct()
    texts = documents.select(F.col("doc_id").cast("long"), "text", "lang").join(F.broadcast(sample), "doc_id").where("lang = learned")
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([*batches])
        every = every.sort_values(["doc_id", "lang"])
        model = fit(every["text"].tolist(), every["lang"].tolist())
        yield pd.DataFrame({"languages": [list(model.languages)], "weights": [model.weights.tobytes()], "transition": [model.transition.tobytes()]})

    made = rows.mapInPandas(run, "languages array<string>, weights binary, transition binary").collect()
    if not made:
        return fit([], [])
    names, k = tuple(made[0]["languages"]), len(made[0]["languages"])
    return Model(names, np.frombuffer(made[0]["weights"], np.float32).reshape(-1, k), np.frombuffer(made[0]["transition"]).reshape(k, k))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; ``und`` with score 0 for texts without a letter."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [*held.value.predict(batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    docs = documents.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id")).alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def word_labels(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, words`` for every row: the words of code-switched text, lower-cased and in order, each with its language and posterior.

    ``words`` is empty for null texts, texts without a letter, and if nothing was learned.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])
        for batch in batches:
            got = [[dict(zip(("word", "lang", "score"), w, strict=True)) for w in held.value.label(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(word))], ["doc_id", "words"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, words array<struct<word string, lang string, score double>>")


def predicted(documents: DataFrame, model: Model, name: str = "lang_pred", least: float = 0.0) -> DataFrame:
    """``documents`` with the column ``name``, the predicted language, ``und`` below the score ``least``; a column of that name is replaced. Rows stay where they are."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop(name)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([g[0] if g[1] >= least else UNKNOWN for g in held.value.predict(batch.column(at).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, name])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(name, StringType())]))


def identify(documents: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Train on ``documents(doc_id, text, lang)`` and predict for every row.

    Rows with a null lang, text or doc_id are predicted but not learned from. Texts that are
    null or have no letter, and all texts if nothing was learned, are ``und`` with score 0.
    Ties go to the language that sorts first. Repeated rows stay. An empty table gives no rows.
    """
    return predict(documents, train(documents, max_rows))
