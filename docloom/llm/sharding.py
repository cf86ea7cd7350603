"""Sharding by vector bin packing.

Groups of equal texts are vectors of bytes, tokens and rows. Each goes, largest first, to
the shard whose residual capacity has the highest dot product with it, among those with room
in all three; swaps of items of equal rows then even out the bytes. What is packed stays bounded
at any size: groups larger than a shard are cut into pieces, and the tail of small groups is
packed as cells of groups of one size class, whose vectors are the exact sums of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

SHARDS, OVERHEAD, LAW = 40, 16, "bytes"
#: Cells that small groups are packed in, for each shard; parts of each shard that are numbered in one task.
CELLS, NUMBERED = 256, 64
#: A group above this share of a shard's bytes, tokens or rows is packed by itself; one above a whole shard's in pieces.
HEAVY = 1 / 512
#: Pieces of a shard's size that a group larger than a shard is cut into. Copies of one id that weigh more are dealt one by one.
PIECES = 64
#: Copies of one id that are numbered in one task.
COPIES = 1 << 16
#: Difference in bytes between two shards, as a share of the mean, that swaps leave alone.
EVEN = 0.002

DIMS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each vector (bytes, tokens, rows).

    Every dimension is scaled to one shard's fair share, so bytes, tokens and rows weigh
    alike where they are scarce. Among shards with room in all three the highest dot product
    wins, ties to the lowest number; where none has room, the shard that overflows least.
    """
    scaled = _scaled(vectors, shards)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled[:, 0])):
        after = residual - scaled[i]
        fits = (after >= -1e-9).all(axis=1)
        value = np.where(fits, residual @ scaled[i], -np.inf) if fits.any() else after.min(axis=1)
        out[i] = value.argmax()
        residual[out[i]] -= scaled[i]
    return out


def _scaled(vectors: np.ndarray, shards: int) -> np.ndarray:
    return vectors / np.maximum(vectors.sum(axis=0) / shards, 1e-9)


def even_out(vectors: np.ndarray, placed: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """``placed`` after swaps between the shard with least bytes and the fullest that has a fitting partner.

    Two items of equally many rows change places if that brings the shards' bytes nearer to each other; each
    swap takes the pair that closes the gap best. It ends when no swap helps or the gap is under ``EVEN``.
    """
    scaled, rows, out = _scaled(vectors, shards), vectors[:, 2], placed.copy()
    load = np.zeros(shards)
    np.add.at(load, out, scaled[:, 0])
    while len(out):
        low = int(load.argmin())
        swap = next(filter(None, (_best_swap(scaled[:, 0], rows, out, int(high), low, load[high] - load[low]) for high in np.argsort(-load, kind="stable"))), None)
        if not swap:
            break
        x, y = swap
        load[out[x]] -= scaled[x, 0] - scaled[y, 0]
        load[low] += scaled[x, 0] - scaled[y, 0]
        out[x], out[y] = low, out[x]
    return out


def _best_swap(size: np.ndarray, rows: np.ndarray, placed: np.ndarray, high: int, low: int, gap: float) -> tuple[int, int] | None:
    """An item of shard ``high`` and one of ``low`` of as many rows, whose sizes differ by the nearest to half the gap."""
    theirs, mine = np.flatnonzero(placed == high), np.flatnonzero(placed == low)
    best, least = None, gap / 2 * 0.98
    if gap <= EVEN:
        return None
    for n in np.intersect1d(rows[theirs], rows[mine]):
        a, b = theirs[rows[theirs] == n], mine[rows[mine] == n]
        b = b[np.argsort(size[b], kind="stable")]
        at = np.searchsorted(size[b], size[a] - gap / 2)
        for j in (np.maximum(at - 1, 0), np.minimum(at, len(b) - 1)):
            off = np.abs(size[a] - size[b[j]] - gap / 2)
            if off.min() < least:
                least, best = off.min(), (int(a[off.argmin()]), int(b[j[off.argmin()]]))
    return best


def _text() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def _keys(documents: DataFrame, *more: Column) -> DataFrame:
    """``more`` and, for each row, ``size``, ``tokens``, ``g`` (equal for equal texts), ``d`` (equal for copies of one id) and ``class``.

    A size class is the length and the two leading bits of bytes and of tokens as binary numbers.
    """
    keyed = documents.select(*more, (F.length(_text()) + OVERHEAD).cast("long").alias("size"), word_count(F.col("text")).alias("tokens"), F.xxhash64(F.col("text").isNull(), _text(), F.length(_text())).alias("g"), F.xxhash64(F.col("doc_id").cast("long"), F.crc32(_text())).alias("d"))
    binary = [F.bin(c) for c in ("size", "tokens")]
    return keyed.withColumn("class", F.xxhash64(*(F.length(b) for b in binary), *(F.substring(b, 1, 2) for b in binary)))


def _sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def _joined(keyed: DataFrame, *lists: DataFrame) -> DataFrame:
    """``keyed`` with what the lists say of its group, its copies' id and its class; their sizes are bounded by the parameters."""
    for found, on in zip(lists, ("g", ["g", "d"], "class"), strict=False):
        keyed = keyed.join(F.broadcast(found), on, "left")
    return keyed


def _item() -> tuple[Column, Column]:
    """Kind and key of what a row is packed with: a piece of its group, or a cell of its class; copies that are dealt get theirs by number."""
    piece = F.xxhash64("g", F.pmod("d", F.col("pieces")))
    cell = F.xxhash64("class", F.pmod(F.xxhash64("g", F.lit(1)), F.col("cells")))
    alone = F.col("pieces").isNotNull()
    return alone.cast("int").alias("kind"), F.when(alone, piece).otherwise(cell).alias("item")


def _plan(sized: DataFrame, shards: int, cells: int, heavy: float) -> tuple[DataFrame, ...]:
    """Heavy groups with their pieces, copies to be dealt one by one, cells of each class, and the shard of each item."""
    totals = sized.agg(*_sums()).first()
    # in shards: the scarcest of the three dimensions
    weight = F.greatest(*(F.col(c) * shards / max(1, n or 0) for c, n in zip(DIMS, totals, strict=True)))
    large = sized.groupBy("g").agg(*_sums()).where(weight > heavy)
    large = materialize(large.select("g", F.when(weight > 1, F.ceil(weight * PIECES)).otherwise(1).cast("int").alias("pieces")), "large")
    copies = sized.join(F.broadcast(large.where("pieces > 1").select("g")), "g").groupBy("g", "d").agg(*_sums()).where((weight * PIECES > 1) & (F.col("rows") > 1))
    copies = materialize(copies.select("g", "d", *DIMS, F.least(F.ceil(weight * PIECES), "rows").cast("int").alias("dealt")), "copies")
    dealt = copies.select("g", "d", "dealt")
    small = sized.join(F.broadcast(large), "g", "left").where("pieces is null")
    classes = materialize(small.groupBy("class").agg(*_sums()).select("class", F.ceil(weight * cells).cast("int").alias("cells")), "classes")
    items = _joined(sized, large, dealt, classes).where("dealt is null").groupBy(*_item()).agg(*_sums())
    each = copies.select(F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)).alias("n"), "g", "d", "dealt", *DIMS)
    each = each.select(F.lit(2).alias("kind"), F.xxhash64("g", "d", "n").alias("item"), *((F.col(c) / F.col("dealt")).alias(c) for c in DIMS))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if every:
            rows = pd.concat(every).sort_values(["kind", "item"])
            vectors = rows[list(DIMS)].to_numpy(float)
            yield pd.DataFrame({"kind": rows["kind"], "item": rows["item"], "shard": even_out(vectors, pack(vectors, shards), shards)})

    return large, dealt, classes, materialize(items.union(each).repartition(1).mapInPandas(place, "kind int, item long, shard int"), "placed")


def _placed(keyed: DataFrame, plan: tuple[DataFrame, ...]) -> DataFrame:
    """``keyed`` (with ``u``, a number of each row) and its ``shard``."""
    large, dealt, classes, placed = plan
    joined = _joined(keyed, large, dealt, classes)
    rows = joined.where("dealt is null").withColumns(dict(zip(("kind", "item"), _item(), strict=True)))
    if not dealt.isEmpty():  # copies of an id above a piece are numbered, in as many tasks as they need
        parts = joined.where("dealt is not null")
        sizes = parts.groupBy("g", "d").agg(F.ceil(F.count("*") / COPIES).alias("parts"))
        parts = parts.join(F.broadcast(sizes), ["g", "d"]).withColumn("part_", F.pmod(F.xxhash64("u"), "parts"))
        number = F.row_number().over(Window.partitionBy("g", "d", "part_").orderBy("u"))
        parts = parts.withColumn("number_", number).withColumn("kind", F.lit(2))
        rows = rows.unionByName(parts.withColumn("item", F.xxhash64("g", "d", F.pmod(F.col("number_"), F.col("dealt")))).select(rows.columns))
    return rows.join(F.broadcast(placed), ["kind", "item"])


def _sized(documents: DataFrame) -> DataFrame:
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.crc32(_text()).alias("text_crc32")]
    return materialize(_keys(documents, *own).withColumn("u", F.monotonically_increasing_id()), "sized")


def shard(documents: DataFrame, shards: int = SHARDS, cells: int = CELLS, heavy: float = HEAVY) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``documents(doc_id, text)``.

    ``size``: UTF-8 bytes plus 16; a null text has no bytes and checksum 0. The law is ``bytes``: shards' sizes
    are near equal, and so are their tokens and rows as far as the texts allow. Rows with equal texts (nulls are
    equal) share a shard, unless they weigh more than one in any of the three; then pieces of the group, by hash of
    doc_id, are placed as groups, and copies of one id that weigh more than a piece are dealt by number. A single
    text above a shard's size stays whole, and its shard is as much larger.
    ``slot`` numbers a shard's rows from 0 without gaps, by hash, doc_id and checksum.
    ``grown_shard`` is null under this law. Repeated rows stay; an empty table gives no rows.

    Groups are summed before the shuffle. At most ``3 * shards / heavy`` groups weigh over ``heavy`` of a shard, a class of
    small groups has as many cells as its share of ``cells`` a shard (one at least), and pieces and dealt copies are
    ``PIECES`` of a shard, so what is packed in one task is bounded, whatever the table's size.
    Slots are prefix counts over parts of each shard, then row numbers within a part.
    """
    sized = _sized(documents)
    # equal rows are many parts where they are dealt
    part = F.when(F.col("kind") == 2, F.xxhash64("u")).otherwise(F.col("d"))
    dealt = _placed(sized, _plan(sized, shards, cells, heavy)).withColumn("part", F.pmod(part, F.lit(NUMBERED)))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", start.alias("start"))
    row = F.row_number().over(Window.partitionBy("shard", "part").orderBy("d", "doc_id", "text_crc32", "size")) - 1
    out = dealt.withColumn("row", row).join(F.broadcast(counts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents with their shard as one Parquet folder per shard."""
    sharded_documents(documents, shards).write.partitionBy("shard").parquet(path)


def sharded_documents(documents: DataFrame, shards: int = SHARDS, cells: int = CELLS, heavy: float = HEAVY) -> DataFrame:
    """``documents`` with ``shard``; a column of that name is replaced. Texts are shuffled only where copies of an id are dealt."""
    keep = [c for c in documents.columns if c != "shard"]
    plan = _plan(_sized(documents), shards, cells, heavy)
    keyed = _keys(documents, F.struct(*keep).alias("row_")).withColumn("u", F.monotonically_increasing_id())
    return _placed(keyed, plan).select("row_.*", "shard")
