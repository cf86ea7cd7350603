"""Suffix-array dedup: bytes covered by a string of a given length that starts anywhere else, too.

Strings (*windows*) meet by content. A window belongs to the piece of ``PIECE`` bytes in it with the least
hash, so equal windows belong to equal pieces; neighbouring windows of one piece are a *context*.
Contexts whose piece occurs once hold no repeated window and go no further. The others are counted by
content; of each different one a single copy is dealt to a shard by its piece.
A shard joins its contexts to one string, sorts its suffixes by induced sorting and takes the
permuted common prefixes: a window is repeated if its suffix shares the window's length with a neighbour
in the array, or if its context is held more than once. What a shard finds goes back to all holders of a context.

A piece with very many different contexts (as at the ends of a passage that a third of all documents
hold) is split: its windows become contexts of their own, so each shard's groups stay bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, shared_dir, tidy_shuffles
from .suffixes import repeated

LENGTH, PIECE = 200, 64
#: Bytes of a shard, and different contexts of one piece in it.
SHARD, GROUP = 2_000_000, 1024
#: Bytes hashed at once.
BLOCK = 1 << 18
PLACE = (2 * BLOCK).bit_length()

TEXT = "id long, rest int"
CONTEXT = f"piece long, content long, {TEXT}, start int, windows int, copies long"
KEY = ["piece", "content"]


class Hashes:
    """Polynomial hashes, modulo 2**64, of random values of bytes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        """What substrings' hashes are taken from."""
        if len(self.up) <= len(text):
            size = 2 * len(text)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (self.base, self.inverse))
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.values[text] * self.up[: len(text)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def contexts(text: np.ndarray, borders: np.ndarray, hashes: tuple[Hashes, Hashes], length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Runs of windows that belong to one place of a piece: hash of the piece and of the content, first window, number of windows.

    ``borders``: ends of the texts that ``text`` joins; no window crosses them.
    """
    width, windows = length - piece + 1, len(text) - length + 1
    sums, more = hashes[0].sums(text), hashes[1].sums(text)
    pieces = _mixed(hashes[0].of(sums, slice(0, len(text) - piece + 1), slice(piece, None)))
    # the least hash of each window, the first of equal ones: place in the low bits
    low = np.uint64((1 << PLACE) - 1)
    ranked = (pieces & ~low) | np.arange(len(pieces), dtype=np.uint64)
    rows = np.concatenate([ranked, np.full(-len(ranked) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : width - 1 + windows]
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    owner = (np.minimum(ahead, behind) & low).astype(np.int64)
    for end in borders[:-1].tolist():
        owner[max(0, end - length + 1) : end] = -1
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    count = np.diff(first, append=windows)
    inside = owner[first] >= 0
    first, count = first[inside], count[inside]
    return pieces[owner[first]].view(np.int64), _mixed(hashes[1].of(more, first, first + count + length - 1)).view(np.int64), first, count


def _blocks(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some rows at once: text, ends of its parts, their rows, and where in its row a part starts.

    Long rows come in parts that overlap by a window less one byte, so each window is in one part.
    """
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        size = offsets[row + 1] - offsets[row]
        if size > BLOCK:
            for at in range(0, size - length + 1, BLOCK):
                part = data[offsets[row] + at : min(offsets[row + 1], offsets[row] + at + BLOCK + length - 1)]
                yield part, np.array([len(part)]), np.array([row]), np.array([at])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        rows = np.arange(row, last)
        yield data[offsets[row] : offsets[last]], offsets[row + 1 : last + 1] - offsets[row], rows, np.zeros(len(rows), np.int64)
        row = last


def _cut(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """The contexts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(1), Hashes(2)
        for batch in batches:
            for text, ends, rows, bases in _blocks(batch.column("bytes"), length):
                if len(text) < length:
                    continue
                pieces, content, first, count = contexts(text, ends, hashes, length, piece)
                part = np.searchsorted(ends, first, side="right")
                start = first - (ends[part] - np.diff(ends, prepend=0)[part]) + bases[part]
                of = batch.select(["id", "rest", "copies"]).take(pa.array(rows[part]))
                columns = [pa.array(pieces), pa.array(content), of.column("id"), of.column("rest"), pa.array(start, pa.int32()), pa.array(count, pa.int32()), of.column("copies")]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "content", "id", "rest", "start", "windows", "copies"])

    return texts.select("id", "rest", F.col("text").cast("binary").alias("bytes"), "copies").mapInArrow(run, CONTEXT)


def _with_text(texts: DataFrame, some: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with the contexts of ``some`` in them, as arrays in the row: one row a text, and no shuffle of texts."""
    own = some.groupBy("id", "rest").agg(F.collect_list(F.struct(*columns)).alias("own"))
    return texts.join(own, ["id", "rest"]).select("id", "rest", F.col("text").cast("binary").alias("bytes"), "copies", *[F.col(f"own.{c}").alias(c) for c in columns])


def _single(texts: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """Each window of ``some`` contexts as a context of its own, whose piece is the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(3), Hashes(4)
        for batch in batches:
            for at in range(len(batch)):
                text = np.frombuffer(batch.column("bytes")[at].as_buffer(), np.uint8)
                starts, counts = (batch.column(c)[at].values.to_numpy().astype(np.int64) for c in ("start", "windows"))
                for low in range(0, len(text) - length + 1, BLOCK):  # no more than a block is hashed at once
                    sums = [h.sums(text[low : low + BLOCK + length - 1]) for h in hashes]
                    windows = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    windows = windows[(windows >= low) & (windows < low + BLOCK)] - low
                    found = [_mixed(h.of(s, windows, windows + length)).view(np.int64) for h, s in zip(hashes, sums, strict=True)]
                    n = len(windows)
                    columns = [*map(pa.array, found), pa.array([batch.column("id")[at].as_py()] * n, pa.int64()), pa.array([batch.column("rest")[at].as_py()] * n, pa.int32())]
                    columns += [pa.array(windows + low, pa.int32()), pa.array(np.ones(n), pa.int32()), pa.array([batch.column("copies")[at].as_py()] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["piece", "content", "id", "rest", "start", "windows", "copies"])

    return _with_text(texts, some, ["start", "windows"]).mapInArrow(run, CONTEXT)


def _copied(texts: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The bytes of one holder of each different context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                text = memoryview(batch.column("bytes")[at].as_buffer())
                of = {c: batch.column(c)[at].values for c in ("piece", "content", "start", "windows", "held")}
                bytes_ = [text[s : s + n + length - 1] for s, n in zip(of["start"].to_pylist(), of["windows"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([of["piece"], of["content"], of["held"], pa.array([bytes(b) for b in bytes_], pa.binary())], ["piece", "content", "held", "bytes"])

    return _with_text(texts, kinds, ["piece", "content", "start", "windows", "held"]).mapInArrow(run, "piece long, content long, held long, bytes binary")


def shard_repeats(texts: list[bytes], twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context of a shard (held ``twice`` or more, or once) which of its windows are repeated in the shard.

    Each goes into the string once: of what is held twice all windows are repeated, and one copy shows them to the other contexts.
    """
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # no text has a byte of 255: it parts contexts, as 0
    found = repeated(joined, length)
    size = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    return [found[a : a + n - length + 1] | bool(more) for a, n, more in zip(starts.tolist(), size.tolist(), twice.tolist(), strict=False)]


def _spans_of(flags: np.ndarray) -> list[int]:
    """Runs of true values as first, last + 1, first, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _sorted_shards(copied: DataFrame, length: int) -> DataFrame:
    """``piece, content, runs``: the repeated windows of each different context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            found = shard_repeats(rows["bytes"].to_pylist(), (rows["held"].to_numpy() > 1).astype(np.int64), length)
            runs = pa.array([_spans_of(f) for f in found], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([rows["piece"].combine_chunks(), rows["content"].combine_chunks(), runs], ["piece", "content", "runs"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("shard")[0].as_py() != shards[a]:
                    yield solved()
                held.append(batch.slice(a, b - a))
        if held:
            yield solved()

    return copied.mapInArrow(run, "piece long, content long, runs array<int>").where(F.size("runs") > 0)


def _merged(found: DataFrame, length: int) -> DataFrame:
    """``id, rest, spans``: bytes covered by repeated windows, as the longest runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(len(batch)):
                runs = batch.column("found")[at].values.to_numpy().reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                ends = np.maximum.accumulate(runs[:, 1]) + length - 1
                first = np.concatenate([[True], runs[1:, 0] > ends[:-1]])
                out.append([{"first": int(a), "end": int(b)} for a, b in zip(runs[first, 0], ends[np.concatenate([first[1:], [True]])], strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rest"), pa.array(out, kind)], ["id", "rest", "spans"])

    shifted = F.transform("runs", lambda r: F.col("start") + r)
    by_text = found.select("id", "rest", shifted.alias("runs")).groupBy("id", "rest").agg(F.flatten(F.collect_list("runs")).alias("found"))
    return by_text.mapInArrow(run, f"{TEXT}, spans array<struct<first: int, end: int>>")


def identified(docs: DataFrame) -> DataFrame:
    """Documents with two hashes of the text (88 bits together) that stand for it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "id": F.xxhash64(text), "rest": F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0xFFFFFF)).cast("int")})


def _distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """Texts of at least ``length`` bytes with their copies, as a table in buckets of the hash: later joins by text don't shuffle it."""
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= length)
    texts = long.groupBy("id", "rest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # those of the grouping, so each task fills its own
    with tidy_shuffles(spark):
        texts.write.bucketBy(buckets, "id", "rest").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._path = f"{shared_dir(spark)}/{name}"
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, shard: int = SHARD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Different texts of ``docs(id, rest, text)`` and the spans to remove from them, as ``id, rest, spans``."""
    if not 8 <= piece < length < BLOCK:
        raise ValueError("a piece has at least 8 bytes and is shorter than the strings, those shorter than a block")
    spark = docs.sparkSession
    texts = _distinct_texts(docs, length)
    with tidy_shuffles(spark):
        cut = materialize(_cut(texts, length, piece), "contexts")
        of_piece = lambda df: df.groupBy("piece").agg(F.sum("copies").alias("n")).where("n > 1").select("piece")
        shared = materialize(of_piece(cut), "pieces")
        held = materialize(cut.join(shared, "piece"), "shared")
        forget(cut)
        as_kinds = lambda df: df.groupBy(*KEY).agg(F.sum("copies").alias("held"), *[F.first(c).alias(c) for c in ("id", "rest", "start", "windows")])
        kinds = materialize(as_kinds(held), "kinds")
        crowded = materialize(kinds.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") > group).select("piece"), "crowded")
        if not crowded.isEmpty():
            single = materialize(_single(texts, held.join(crowded, "piece"), length), "windows")
            single_shared = materialize(of_piece(single), "pieces")
            held = materialize(held.join(crowded, "piece", "left_anti").unionByName(single.join(single_shared, "piece")), "shared")
            kinds = materialize(kinds.join(crowded, "piece", "left_anti").unionByName(as_kinds(single.join(single_shared, "piece"))), "kinds")
            forget(single)
        size = kinds.agg(F.sum(F.col("windows") + length)).first()[0] or 0
        dealt = _copied(texts, kinds, length).withColumn("shard", F.pmod(F.hash("piece"), F.lit(size // shard + 1)))
        found = materialize(_sorted_shards(dealt.repartition("shard").sortWithinPartitions("shard"), length), "found")
        spans = materialize(_merged(held.join(found, KEY), length), "spans")
    return texts, spans


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes outside of ``spans``, one after another."""
    data = text.cast("binary")
    piece = lambda first, end: F.substring(data, first + 1, end - first)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("pieces"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["pieces"], F.array(piece(s["at"], x["first"]))).alias("pieces"))
    done = F.aggregate(spans, state, step)
    whole = F.concat(done["pieces"], F.array(piece(done["at"], F.octet_length(text))))
    return F.aggregate(whole, F.lit(b""), lambda a, b: F.concat(a, b))


def without_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, kept_sha256`` of ``docs(doc_id, text)``: every row, less its repeated bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place, of any
    document or its own; strings are judged on the input. Strings don't cross documents. Texts are UTF-8 bytes, so
    ``kept`` may begin or end within a character. A null text is empty; empty and short ones stay whole. Repeated rows
    are copies of each other, with or without ids, so they lose all. Other columns are ignored.
    """
    rows = identified(docs.select("doc_id", "text"))
    texts, spans = repeated_spans(rows.select("id", "rest", "text"), length, piece, shard, group)
    kept = texts.join(spans, ["id", "rest"]).select("id", "rest", "spans", kept_bytes(F.col("text"), F.col("spans")).alias("kept"))
    # written, so that the copies of one text (a third of all rows, maybe) are a side of the join that can be split
    kept = materialize(kept.withColumn("sha", F.sha2("kept", 256)), "kept").withColumnsRenamed({"id": "id_", "rest": "rest_"})
    same = (F.col("id") == F.col("id_")) & (F.col("rest") == F.col("rest_"))
    data = F.col("text").cast("binary")
    none = F.array().cast("array<struct<first: int, end: int>>")
    rows = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "whole": F.sha2(data, 256)})
    return rows.join(kept, same, "left").select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept", data).alias("kept"), F.coalesce("sha", "whole").alias("kept_sha256"))


def oracle_sql(length: int = LENGTH) -> str:
    """For DuckDB: every string of every text, as hexadecimal digits."""
    return f"""
    with texts as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    parts as materialized (select r, 500 * j as base, substr(h, 1000 * j + 1, {2 * (length + 499)}) as part from texts, unnest(range(0, (len(h) // 2 - {length}) // 500 + 1)) as t(j)),
    strings as materialized (select r, base + i as i, hash(substr(part, 2 * i + 1, {2 * length})) as k from parts, unnest(range(0, len(part) // 2 - {length} + 1)) as t(i)),
    often as materialized (select k from strings group by k having count(*) > 1),
    found as (select r, i from strings semi join often using (k)),
    marked as (select r, i, coalesce((i > lag(i) over (partition by r order by i) + {length})::int, 1) as new from found),
    runs as (select r, i, sum(new) over (partition by r order by i) as run from marked),
    spans as (select r, run, min(i) as a, max(i) + {length} as b from runs group by r, run),
    gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as before from spans),
    ends as (select r, count(*) as n, sum(b - a)::bigint as removed, max(b) as tail from spans group by r),
    pieces as (select r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from gaps join texts using (r) group by r)
    select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
        sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
    from texts left join ends using (r) left join pieces using (r)"""


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the result of ``without_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
