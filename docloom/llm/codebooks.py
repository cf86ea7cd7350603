"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

Codebooks are integers, so distances, means and ties are exact and the same on any number of
executors. They are broadcast (``entries`` times the dimensions, whatever the table's size); tasks
compute all distances of an Arrow batch by expanding the norm, with int64 matrix products, and
send only counts and sums by entry to the shuffle that merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import FINITE_SQL, finite, integers, integers_sql, least, matrix, merged, sums_by

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances a task holds at once.
ROWS = 2048

SUMS = "dim int, part int, entry int, position int, n long, s long"
CODED = "vec_id long, label string, dim int, code string, error long"


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, by expanding the norm in int64."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the first nearest entry of each part; ``books``: parts x entries x width."""
    width = books.shape[2]
    found = [least(distances(x[:, p * width : (p + 1) * width], book)) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Batches cut to ``rows`` vectors of one dimension."""
    for batch in batches:
        dims = batch.column("x").value_lengths().to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, len(part), rows):
                block = part.slice(at, rows)
                yield int(dim), block, matrix(block.column("x"))


def _first_books(table: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Codebooks by dimension, from the rows of the smallest ids; repeated ids by their vectors."""
    order = F.row_number().over(Window.partitionBy("dim").orderBy("vec_id", "x"))
    first = table.where("vec_id is not null").withColumn("nth", order).where(F.col("nth") <= entries)
    out: dict[int, list] = {}
    for row in sorted(first.select("dim", "nth", "x").collect(), key=lambda r: (r["dim"], r["nth"])):
        out.setdefault(row["dim"], []).append(row["x"])
    return {dim: np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy() for dim, rows in out.items()}


def _improved(table: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One round: entries become the floor of the mean of the parts they are nearest to; unused ones stay."""
    sent = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for dim, _, x in _blocks(batches):
            if dim not in sent.value:
                continue
            book = sent.value[dim]
            count, total = totals.setdefault(dim, [np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)])
            index, _ = nearest(x, book)
            for p in range(len(book)):
                n, s = sums_by(index[:, p], x[:, p * book.shape[2] : (p + 1) * book.shape[2]], book.shape[1])
                count[p] += n
                total[p] += s
        for dim, (count, total) in totals.items():
            part, entry = np.nonzero(count)
            width = total.shape[2]
            columns = [np.full(len(part) * width, dim), np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(count[part, entry], width), total[part, entry].ravel()]
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "part", "entry", "position", "n", "s"])

    out = {dim: book.copy() for dim, book in books.items()}
    for r in merged(table.select("x").mapInArrow(run, SUMS), ["dim", "part", "entry", "position"]):
        out[r["dim"]][r["part"], r["entry"], r["position"]] = r["s"] // r["n"]
    sent.unpersist()
    return out


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks (parts x entries x width) by dimension of a table ``vec_id, dim, x``."""
    books = _first_books(table, parts, entries)
    for _ in range(rounds if books else 0):
        books = _improved(table, books)
    return books


def encode(table: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, label, dim, code, error``: two hex digits a part, and the squared distances to the entries, summed."""
    sent = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block, x in _blocks(batches):
            if dim not in sent.value:
                continue
            index, error = nearest(x, sent.value[dim])
            digits, step = index.astype(np.uint8).tobytes().hex(), 2 * index.shape[1]
            codes = [digits[i : i + step] for i in range(0, len(digits), step)]
            columns = [block.column("vec_id"), block.column("label"), pa.array(np.full(len(x), dim), pa.int32()), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "code", "error"])

    return table.select("vec_id", "label", "x").mapInArrow(run, CODED)


def decode(code: str, book: np.ndarray) -> list[int]:
    """The integers that a code stands for: its entries, one after another."""
    return [int(c) for p, part in enumerate(book) for c in part[int(code[2 * p : 2 * p + 2], 16)]]


def sha256(book: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``.

    Components become ``floor(scale * x)``. Every dimension has codebooks of its own, which start as
    the ``entries`` rows of smallest ids (all rows, if fewer; of repeated ids first the least vector).
    ``label_error`` sums the errors of equal labels, nulls together.

    Vectors that are null or hold null or non-finite components take no part, nor do those that ``parts``
    doesn't divide, empty ones among them. Rows without an id are coded but start no codebook; if a dimension has no ids
    at all, there is nothing to code its rows by. Repeated rows are rows each. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    size = F.size("embedding")
    good = vectors.where(finite(F.col("embedding")) & (size > 0) & (size % parts == 0))
    kind = vectors.schema["label"].dataType
    table = materialize(good.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), size.alias("dim"), integers(F.col("embedding"), scale).alias("x")), "integers")
    books = train(table, parts, entries, rounds)
    coded = materialize(encode(table, books), "codes")
    label = F.col("label").cast(kind).alias("label")
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, sha256(book)).otherwise(digest)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"), label)


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """For DuckDB, over vectors of one dimension."""
    steps = [
        f"kept as materialized (select vec_id, label, row_number() over (order by vec_id) as r, {integers_sql(scale)} as x, len(embedding) // {parts} as w from embeddings where {FINITE_SQL} and len(embedding) > 0 and len(embedding) % {parts} = 0)",
        f"cut as materialized (select r, p, x[p * w + 1 : (p + 1) * w] as x from kept, range({parts}) t(p))",
        "vecs as materialized (select r, p, x::double[] as x, list_inner_product(x::double[], x::double[]) as xx from cut)",
        f"book0 as materialized (select p, r - 1 as e, x from cut where r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} as materialized (select r, p, min(((xx - 2 * list_inner_product(v.x, b.x::double[]) + list_inner_product(b.x::double[], b.x::double[]))::bigint) * {entries} + e) as best from vecs v join book{k} b using (p) group by r, p)")
        if k < rounds:
            steps += [
                f"comp{k} as (select p, best % {entries} as e, i, sum(x[i])::bigint as s, count(*) as n from near{k} join cut using (r, p), range(1, 1 + (select max(w) from kept)) t(i) group by all)",
                f"mean{k} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as x from comp{k} group by p, e)",
                f"book{k + 1} as materialized (select p, e, coalesce(m.x, b.x) as x from book{k} b left join mean{k} m using (p, e))",
            ]
    last = f"coded as (select r, string_agg(printf('%02x', best % {entries}), '' order by p) as code, sum(best // {entries})::bigint as error from near{rounds} group by r)"
    digest = f"digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})"
    return f"with {', '.join([*steps, last, digest])} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (r), digest"
