"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its 2-bit segments. Two
fingerprints that differ in at most ``r`` bits have vectors within Manhattan distance
``r``. The grid has one cell for each choice of ``GROUPS - r`` of ``GROUPS`` groups of
segments and the counts in them: with ``r`` units to spend, at least so many groups stay
in place, so every near pair meets in some cell. In a cell the lower bound is checked
first, then the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

SHINGLE, SEED, RADIUS, GROUPS = 4, 42, 4, 8
#: Fingerprints of one cell that a task compares at once; larger cells are compared block by block.
CELL_BLOCK = 4096
ODD = np.uint64(0x5555555555555555)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text's word shingles, as an unsigned 64-bit integer; 0 if it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (signed), ``text_hash`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), _text_hash()).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary")).alias("text_hash")


def embed(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, each in two bits of one integer."""
    return fps - ((fps >> np.uint64(1)) & ODD)


def embedded_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings: a lower bound of the differing bits."""
    # counts 0, 1, 2 as unary codes 00, 01, 11: then differing bits are differing units
    a, b = a | ((a >> np.uint64(1)) & ODD), b | ((b >> np.uint64(1)) & ODD)
    return np.bitwise_count(a ^ b)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def cells(fps: np.ndarray, radius: int = RADIUS, groups: int = GROUPS) -> np.ndarray:
    """The cells of each fingerprint, one row each."""
    emb, width = embed(fps), 64 // groups
    masks = [sum(((1 << width) - 1) << (g * width) for g in kept) for kept in combinations(range(groups), groups - radius)]
    return np.stack([_mix((emb & np.uint64(m)) + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) for n, m in enumerate(masks)], axis=1)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) of the local components of near fingerprints: at most one for each."""
    emb, left, out = embed(fps), np.arange(len(fps)), []
    while len(left):
        root, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            at = queue.pop()
            near = embedded_distance(emb[left], emb[at]) <= radius
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= radius
            queue += (got := left[near]).tolist()
            out += [(fps[root], fps[x]) for x in got]
            left = left[~near]
    return out


def _edges(fp: np.ndarray, radius: int) -> np.ndarray:
    return np.array(forest(fp.view(np.uint64), radius), np.uint64).view(np.int64).reshape(-1, 2)


def _small_cells(cell: np.ndarray, fp: np.ndarray, radius: int, most: int) -> Iterator[np.ndarray]:
    """Near pairs within cells of at most ``most`` rows, sorted by cell: neighbours at each offset, all cells at once."""
    u = fp.view(np.uint64)
    emb = embed(u)
    for d in range(1, most):
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            return
        i = i[embedded_distance(emb[i], emb[i + d]) <= radius]
        i = i[np.bitwise_count(u[i] ^ u[i + d]) <= radius]
        yield np.stack([fp[i], fp[i + d]], axis=1)


def _link(batches: Iterator[pa.RecordBatch], radius: int, block: int, small: int = 16) -> Iterator[pa.RecordBatch]:
    """Edges within cells from rows sorted by cell, with block -1.

    The rows of a cell beyond ``block`` also come out as (cell, fp, block number), to be compared across blocks.
    """
    open_cell, number = None, 0  # the cell whose full blocks have gone out, and its next block's number

    def result(edges: list[np.ndarray], over: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        e = np.concatenate(edges) if edges else np.empty((0, 2), np.int64)
        cell = np.concatenate([np.zeros(len(e), np.int64), *(np.full(len(f), c) for c, _, f in over)])
        at = np.concatenate([np.full(len(e), -1, np.int32), *(np.full(len(f), k, np.int32) for _, k, f in over)])
        b = np.concatenate([e[:, 1], *(f for _, _, f in over)])
        a = np.concatenate([e[:, 0], np.zeros(len(b) - len(e), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(a), pa.array(b)], ["cell", "block", "a", "b"])

    def work(cell: np.ndarray, fp: np.ndarray, last: bool) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        nonlocal open_cell, number
        edges, over = [], []

        def full(c: int, part: np.ndarray) -> None:
            nonlocal open_cell, number
            if c != open_cell:
                open_cell, number = c, 0
            over.append((c, number, part))
            number += 1
            edges.append(_edges(part, radius))

        heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
        end = len(cell) if last or not len(heads) else int(heads[-1])  # the last cell may go on in the next batch
        rest = (cell[end:], fp[end:])
        heads = heads[heads < end]
        sizes = np.diff(np.append(heads, end))
        large = (sizes > small) | (cell[heads] == (open_cell if open_cell is not None else 0)) & (open_cell is not None)
        little = ~np.repeat(large, sizes)
        edges += _small_cells(cell[:end][little], fp[:end][little], radius, small)
        for h, n in zip(heads[large].tolist(), sizes[large].tolist(), strict=True):
            c, own = int(cell[h]), fp[h : h + n]
            if n <= block and c != open_cell:
                edges.append(_edges(own, radius))
                continue
            for at in range(0, n, block):
                full(c, own[at : at + block])
        while len(rest[1]) > block:
            full(int(rest[0][0]), rest[1][:block])
            rest = (rest[0][block:], rest[1][block:])
        return result(edges, over), rest

    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        out, held = work(np.concatenate([held[0], batch.column(0).to_numpy()]), np.concatenate([held[1], batch.column(1).to_numpy()]), False)
        yield out
    yield work(*held, True)[0]


LINKS = "cell long, block int, a long, b long"


def near_edges(distinct: DataFrame, radius: int = RADIUS, groups: int = GROUPS, block: int = CELL_BLOCK) -> DataFrame:
    """``a, b``: edges between distinct fingerprints ``fp`` whose closure is that of all pairs within ``radius`` bits.

    A cell gives a forest, not all its pairs. Blocks of a cell with over ``block`` members are
    compared pairwise as tasks of their own, so no task holds more than two blocks.
    """
    spread = lambda batches: (_cells_batch(b, radius, groups) for b in batches)
    dealt = distinct.select("fp").mapInArrow(spread, "cell long, fp long")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "fp")
    linked = materialize(dealt.mapInArrow(lambda b: _link(b, radius, block), LINKS), "cells")
    edges = linked.where("block < 0").select("a", "b").distinct()
    over = linked.where("block >= 0")
    if not over.isEmpty():
        counts = over.groupBy("cell").agg((F.max("block") + 1).alias("n"))
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
        pairs = over.join(counts, "cell").select("cell", "block", "b", other).where("block <> other")
        pair = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
        pairs = pairs.select(pair.alias("cell"), F.col("b").alias("fp")).repartition("cell").sortWithinPartitions("cell", "fp")
        edges = edges.union(pairs.mapInArrow(lambda b: _link(b, radius, 2 * block + 1), LINKS).where("block < 0").select("a", "b")).distinct()
    return edges


def _cells_batch(batch: pa.RecordBatch, radius: int, groups: int) -> pa.RecordBatch:
    fps = batch.column(0).to_numpy()
    got = cells(fps.view(np.uint64), radius, groups)
    return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64).ravel()), pa.array(np.repeat(fps, got.shape[1]))], ["cell", "fp"])


def near_duplicates(documents: DataFrame, radius: int = RADIUS, groups: int = GROUPS, block: int = CELL_BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``documents(doc_id, text)``.

    ``fingerprint``: 16 hex digits. ``component_id``: the smallest doc_id reachable over pairs
    of fingerprints that differ in at most ``radius`` bits, itself included; equal
    fingerprints are linked. Null and wordless texts have fingerprint zero and are linked like
    others. Texts below four words are one shingle. Repeated rows stay. A null doc_id counts as
    no id: its row takes its component's smallest id. An empty table gives no rows.
    """
    fps = materialize(fingerprints(documents).drop("text_hash"), "fingerprints")
    named = _named(fps, radius, groups, block).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hexed, "component_id")


def _named(fps: DataFrame, radius: int, groups: int, block: int) -> DataFrame:
    """``fp, component`` (a fingerprint), ``component_id`` of the distinct fingerprints."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    comps = components(near_edges(distinct, radius, groups, block))
    label = distinct.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    label = materialize(label, "labels")
    least = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return label.join(least, "component").select("fp", "component", "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: of the smallest doc_id, and of its rows the one with the least text hash.

    A row is known by doc_id and text hash, so an id with several texts loses only what its
    other groups keep. Rows without a doc_id come last: one stays if no row of its group has an id. Of
    repeated rows of what stays the least by all columns does. The keys that go are found first; only
    repeated rows' texts are aggregated, combined before the shuffle.
    """
    fps = materialize(fingerprints(documents), "fingerprints")
    keys = fps.groupBy("doc_id", "text_hash", "fp").count()
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    keys = materialize(keys.join(_named(fps, RADIUS, GROUPS, CELL_BLOCK), "fp").select("component", "count", rank.alias("rank")), "keys")
    best = keys.groupBy("component").agg(F.min("rank").alias("best"))
    judged = keys.join(best, "component").select(F.col("rank.doc_id").alias("id"), F.col("rank.text_hash").alias("h"), "count", (F.col("rank") == F.col("best")).alias("stays"))
    judged = materialize(judged, "judged")
    judged = judged.select(F.col("id").alias("id_"), F.col("h").alias("hash_"), F.col("count").alias("count_"), "stays")
    row = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row_"), F.col("doc_id").cast("long").alias("own_"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash_"))
    same = (F.col("text_hash_") == F.col("hash_")) & F.col("own_").eqNullSafe(F.col("id_"))
    left = row.join(judged.where("not stays"), same, "left_anti")
    repeated = judged.where("stays and count_ > 1")
    if repeated.isEmpty():
        return left.select("row_.*")
    one = left.join(repeated, same, "left_semi").groupBy("own_", "text_hash_").agg(F.min("row_").alias("row_"))
    return left.join(repeated, same, "left_anti").select("row_.*").union(one.select("row_.*"))
