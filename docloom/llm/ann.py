"""Approximate nearest neighbours from randomly rotated one-bit codes.

A vector, less the corpus mean, is rotated by a fixed random orthogonal matrix and kept
as the signs of its coordinates, with two scalars: its length and its alignment with its
own code. The inner product of a query with the unit vector is estimated from the packed
bits and the alignment; the estimate's error has a known bound that holds with high
probability. Only vectors whose lower bound of the distance beats the best exact
distances so far are reranked on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from .common import materialize

SEED, EPSILON = 7, 2.5
#: Vectors in a block of candidates and of queries, and bytes of the vectors that cut them shorter.
CHUNK, QUERY_BLOCK, BLOCK_BYTES, QUERY_BYTES = 4096, 512, 1 << 21, 1 << 18
#: Shares of the candidates unless they have more blocks than a task takes, those blocks, and queries that a task keeps results for.
SHARES, SHARE_BLOCKS, QUERIES_PER_TASK = 64, 64, 131_072
#: Components of vectors that are compared exactly at once, and share of a block's pairs (one of so many) from which a product rules most out first.
EXACT, DENSE = 1 << 22, 50

BLOCK = "dim int, ids binary, vectors binary, codes binary, norms binary, aligned binary"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix over ``dim`` padded to whole 64-bit words."""
    padded = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((padded, padded)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return x @ matrix[: x.shape[-1]]


def encode(x: np.ndarray, center: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n x words), residual lengths and alignments of vectors."""
    res = rotated(x - center, matrix)
    norm = np.sqrt((res * res).sum(axis=1))
    unit = res / np.where(norm == 0, 1, norm)[:, None]
    codes = np.packbits(res > 0, axis=1, bitorder="little").view(np.uint64)
    aligned = np.abs(unit).sum(axis=1) / np.sqrt(res.shape[1])
    return codes, norm, np.where(norm == 0, 1.0, aligned)


def estimates(q: np.ndarray, center: np.ndarray, matrix: np.ndarray, codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of one query, or of each of many, to coded vectors, and half widths of their bounds."""
    res = rotated(q - center, matrix)
    length = np.sqrt((res * res).sum(axis=-1, keepdims=True))
    signs = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
    d = signs.shape[1]
    width = epsilon * np.sqrt(np.maximum(0, 1 - aligned**2)) / aligned / np.sqrt(max(1, d - 1))
    signs *= (2 * norm / aligned / np.sqrt(d))[:, None]
    est = res @ signs.T
    np.subtract(norm**2 + length**2, est, out=est)
    return est, length * (2 * norm * width) + 1e-9 * length**2  # and what sums round


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _exact_pairs(q: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Distances of the pairs ``q[one], x[two]``, some at once."""
    step = max(1, EXACT // x.shape[1])
    return np.concatenate([np.empty(0), *(exact(q[one[at : at + step]], x[two[at : at + step]].astype(np.float64)) for at in range(0, len(one), step))])


def _improve(qids: np.ndarray, q: np.ndarray, near: np.ndarray, found: np.ndarray, ids: np.ndarray, x: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> None:
    """Put what a block has nearer into the best distances and ids of ascending queries, in place; ties go to the smaller id."""
    k = near.shape[1]
    est, slack = bounds
    at = np.minimum(np.searchsorted(qids, ids), len(qids) - 1)
    own = np.flatnonzero(qids[at] == ids)
    est[at[own], own] = np.nan  # compares as false
    reach = near[:, -1].copy()
    fresh = np.flatnonzero(~np.isfinite(reach))
    if len(fresh) and len(ids) > k + 1:  # the block's nearest by estimate bound the rest
        first = np.argpartition(est[fresh], k, axis=1)[:, : k + 1]
        row, column = np.repeat(fresh, k + 1), first.ravel()
        score = np.where(np.isnan(est[row, column]), np.inf, _exact_pairs(q, x, row, column)).reshape(first.shape)
        reach[fresh] = np.sort(np.concatenate([near[fresh], score], axis=1), axis=1)[:, k - 1]
        est[row, column] -= np.inf  # they are met below
    limit = reach * reach * (1 + 1e-9)
    np.subtract(est, slack, out=slack)
    wanted = slack <= limit[:, None]
    if np.count_nonzero(wanted) > wanted.size / DENSE:  # one product of all is less work than differences of each
        whole = x.astype(np.float64)
        ours, theirs = (q * q).sum(axis=1)[:, None], (whole * whole).sum(axis=1)
        product = q @ whole.T
        product *= -2
        product += (theirs + ours) * (1 - 1e-12)  # what it may round
        wanted &= ~(product > limit[:, None])
    row, column = np.nonzero(wanted)
    score = _exact_pairs(q, x, row, column)
    kept = score <= near[row, -1]
    if not kept.any():
        return
    row, score, names = row[kept], score[kept], ids[column[kept]]
    old = np.unique(row)
    row, score, names = np.concatenate([row, np.repeat(old, k)]), np.concatenate([score, near[old].ravel()]), np.concatenate([names, found[old].ravel()])
    order = np.lexsort((names, score, row))
    row, score, names = row[order], score[order], names[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < k
    near[row[best], place[best]], found[row[best], place[best]] = score[best], names[best]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors without null or non-finite components that are not null, empty or zero."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = (F.size("embedding") > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch.column(1).value_lengths().to_numpy()
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part.column(0).to_numpy(), _matrix(part.column(1))


def centers(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors by dimension: sums are made by task, then added."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                old = total.setdefault(dim, [0, np.zeros(dim)])
                total[dim] = [old[0] + len(x), old[1] + x.sum(axis=0)]
        rows = [(dim, i, float(s), n) for dim, (n, x) in total.items() for i, s in enumerate(x)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "i", "s", "n"]).astype({"dim": "int32", "i": "int32", "s": float, "n": "int64"}), preserve_index=False)

    means = vectors.mapInArrow(sums, "dim int, i int, s double, n long").groupBy("dim", "i").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    out: dict[int, np.ndarray] = {}
    for r in means:
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["mean"]
    return out


def _cuts(n: int, dim: int, rows: int, most: int) -> Iterator[slice]:
    """Pieces of ``n`` vectors: at most ``rows`` of them and ``most`` bytes of doubles, one vector at least."""
    step = min(rows, max(1, most // (8 * dim)))
    yield from (slice(at, at + step) for at in range(0, n, step))


def index(vectors: DataFrame, center: dict[int, np.ndarray], chunk: int, seed: int, kind: type = np.float64) -> DataFrame:
    """Blocks of at most ``chunk`` vectors of one dimension, kept as ``kind``, with their codes and scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                if dim not in matrices:
                    matrices[dim] = rotation(dim, seed)
                for at in _cuts(len(ids), dim, chunk, BLOCK_BYTES):
                    codes, norm, aligned = encode(x[at], center[dim], matrices[dim])
                    row = [[dim], *([c.tobytes()] for c in (ids[at], x[at].astype(kind), codes, norm, aligned))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.int32(), *[pa.binary()] * 5], strict=True)], ["dim", "ids", "vectors", "codes", "norms", "aligned"])

    return vectors.mapInArrow(run, BLOCK)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, epsilon: float = EPSILON, chunk: int = CHUNK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of all other rows for each row whose vec_id ``every`` divides.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows without a vec_id. Only vectors of equal dimension are compared. Of repeated
    query ids one query is made (the least vector); rows with the query's id are never its
    candidates. Fewer candidates than ``k`` are all returned. An empty table gives no rows.

    Shares of the candidates' blocks meet groups of the queries' as cogroups, so that both sides travel by
    shuffles at any size and none is sent to the driver. All queries of a group are estimated against one block at
    once; a task keeps only the ``k`` best of each query, over all the blocks that it sees.
    """
    good = usable(vectors)
    center = centers(good)
    single = vectors.schema["embedding"].dataType.elementType == FloatType()
    kind = np.float32 if single else np.float64  # as the column has them; all sums are of doubles
    blocks = materialize(index(good, center, chunk, seed, kind), "codes")
    queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                for at in _cuts(len(ids), dim, query_block, QUERY_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[at].tobytes()]), pa.array([x[at].astype(kind).tobytes()])], ["dim", "qids", "qvectors"])

    asked = materialize(queries.mapInArrow(pack, "dim int, qids binary, qvectors binary"), "queries")
    n = blocks.count()
    shares, groups = max(min(n, SHARES), -(-n // SHARE_BLOCKS), 1), max(1, -(-asked.count() * query_block // QUERIES_PER_TASK))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.select("*", F.pmod(F.xxhash64("ids"), F.lit(shares)).alias("share"), every_one(groups).alias("grp"))
    right = asked.select("*", every_one(shares).alias("share"), F.pmod(F.xxhash64("qids"), F.lit(groups)).alias("grp"))

    def search(share: pa.Table, group: pa.Table) -> pa.Table:
        qids, found, near = np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty((0, k))
        if len(share) and len(group):
            dim = share.column("dim")[0].as_py()
            qids = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in group.column("qids")])
            asking = np.concatenate([np.frombuffer(b.as_py(), kind).reshape(-1, dim) for b in group.column("qvectors")])
            order = np.argsort(qids)
            qids, asking = qids[order], asking[order].astype(np.float64)
            near, found = np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
            matrix = rotation(dim, seed)
            for row in zip(*(share.column(c) for c in ("ids", "vectors", "codes", "norms", "aligned")), strict=True):
                ids, x, codes, norm, aligned = (np.frombuffer(b.as_py(), t) for b, t in zip(row, (np.int64, kind, np.uint64, np.float64, np.float64), strict=True))
                coded = codes.reshape(len(ids), -1), norm, aligned
                for at in _cuts(len(qids), dim, query_block, QUERY_BYTES):
                    _improve(qids[at], asking[at], near[at], found[at], ids, x.reshape(len(ids), dim), estimates(asking[at], center[dim], matrix, *coded, epsilon))
        at = np.flatnonzero(np.isfinite(near.ravel()))
        return pa.table({"query_id": np.repeat(qids, k)[at], "vec_id": found.ravel()[at], "score": near.ravel()[at]})

    by = ("dim", "share", "grp")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
