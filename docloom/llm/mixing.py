"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes linearly over training. The integral of that
schedule, scaled to the source's target, is its cumulative word demand. Documents of a
source form a stream in hashed order, passed over again from its start where the target
exceeds the source; inverting the demand at a document's place in the stream gives its
training position, and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

#: Weights of the sources in code point order, repeating, and their schedules' relative starts and ends.
WEIGHTS, STARTS, ENDS = (3, 1, 2), (1.5, 0.5, 1.0), (0.5, 1.5, 1.0)
SHARE, MOST_PASSES = 1.5, 2
#: Parts of a source by hash, each ordered in one task; 16 ** HEX of them.
HEX = 3


def _hash(doc_id: Column, text: Column) -> Column:
    """The stream's order: rows of one id are apart if their texts differ."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """``source, place, source_size, target`` from ``source, size``.

    ``share`` of all words goes to the sources by weight; a target stops at ``passes`` times
    its source and the rest is shared by the others, until none is above. That fixed point is
    one level: filling sources in the order of size by weight, the level is what remains
    over the weight that remains, at the first source that can take it. One row per source
    is sorted in one task; a source is a named corpus, so these are few.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * passes).cast("double")
    per = per.select("source", "place", "source_size", weight.alias("weight"), cap.alias("cap"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    per = per.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "place", "level"))).over(every)
    per = per.withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight")))
    return per.select("source", "place", "source_size", target.alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """The progress in [0, 1] at which ``share`` of a source's demand is met, its weight going linearly from ``start`` to ``end``."""
    want = share * (start + end) / 2  # the integral up to x is start x + (end - start) x^2 / 2
    return 2 * want / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * want)))


def _sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, h, part`` of every row."""
    h = _hash(F.col("doc_id"), F.col("text")).alias("h")
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source"), word_count(F.col("text")).alias("size"), h)
    return sized.withColumn("part", F.substring("h", 1, HEX))


def _placed(sized: DataFrame, rows: DataFrame, order: tuple[str, ...], weights: tuple[float, ...], starts: tuple[float, ...], ends: tuple[float, ...], share: float, passes: int) -> DataFrame:
    """``rows`` (``sized``, with other columns or not) with ``source_size``, ``target``, and ``taken`` and ``positions``: arrays of one entry for each pass that takes the row."""
    wanted = targets(sized, weights, share, passes)
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), before.alias("part_start"))
    parts = parts.join(wanted, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = within.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % len(values) + 1).cast("int"))
    every = []
    for n in range(passes):
        start = F.col("part_start") + F.col("inside") + n * F.col("source_size")
        got = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        every.append(F.when(got > 0, F.struct(got.alias("words"), position(start / F.col("target"), of(starts), of(ends)).alias("position"))))
    placed = placed.withColumn("passes", F.array_compact(F.array(*every)))
    return placed.withColumn("taken", F.col("passes.words")).withColumn("positions", F.col("passes.position"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, starts: tuple[float, ...] = STARTS, ends: tuple[float, ...] = ENDS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, position, positions`` for every row of ``documents(doc_id, text, source)``.

    ``size``: words of the whole text, 0 for null. ``target``: words wanted of the row's source;
    null is a source of its own, the last. ``taken``: words that the mix takes, over all
    passes; a source's sum is its target rounded down, as the document in which demand ends
    gives only the words up to there. ``positions``: training progress of each time it is taken, that
    one included; empty if never. ``copies`` counts them, ``position`` is the first. The result is range-sorted by it; wordless
    documents have ``taken`` 0. Ties and repeated rows are ordered by hash of id and text, then
    doc_id, so reruns agree. An empty table gives no rows.

    Texts are read once for their sizes. Streams are prefix sums on two levels: over hash
    parts of each source, whose sums are made before the shuffle, then within each part, so
    a source with a third of all rows is spread over 16 ** HEX tasks' worth of keys.
    """
    sized = materialize(_sized(documents), "sized")
    out = _placed(sized, sized, ("h", "doc_id", "size"), weights, starts, ends, share, passes)
    taken = F.aggregate("taken", F.lit(0).cast("long"), lambda x, y: x + y).alias("taken")
    out = out.select("doc_id", "size", "source_size", "target", taken, F.size("positions").alias("copies"), F.get("positions", F.lit(0)).alias("position"), "positions")
    order = (F.col("position").asc_nulls_last(), "doc_id")
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, starts: tuple[float, ...] = STARTS, ends: tuple[float, ...] = ENDS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """The rows of ``documents`` that the mix takes, one for each pass, range-sorted by training position; a last, partial copy stays whole.

    Written as files, their order is the training order. Every row has positions of its own, also where ids or
    whole rows repeat. Columns of any name stay as they are. Rows travel as one struct, once to the parts of
    their source's stream and once by position.
    """
    keyed = _sized(documents).select("source", "size", "part")
    row = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row_"))
    rows = row.withColumn("h", _hash(F.col("row_.doc_id"), F.col("row_.text"))).select("row_", F.col("row_.doc_id").cast("long").alias("doc_id"), F.col("row_.source").alias("source"), word_count(F.col("row_.text")).alias("size"), "h", F.substring("h", 1, HEX).alias("part"), F.xxhash64("row_").alias("tie"))
    placed = _placed(materialize(keyed, "sized"), rows, ("h", "doc_id", "size", "tie"), weights, starts, ends, share, passes)
    order = ("position", "h", "tie")
    out = placed.select("row_", "h", "tie", F.explode("positions").alias("position"))
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("row_.*")


def _position_sql(share: str) -> str:
    """``position`` in SQL, with the sources' starts and ends in columns ``a`` and ``b``."""
    want = f"(({share}) * (a + b) / 2)"
    return f"2 * {want} / (a + sqrt(greatest(0::double, a * a + 2 * (b - a) * {want})))"


def oracle_sql() -> str:
    """``mix`` with the default parameters as DuckDB SQL; positions as one column for each pass."""
    n = len(WEIGHTS)
    case = lambda values: " ".join(f"when {i} then {float(w)}::double" for i, w in enumerate(values))
    start = lambda k: f"(start + {k} * source_size)"
    got = lambda k: f"greatest(0, least(size, floor(target)::bigint - {start(k)}))"
    taken = " + ".join(got(k) for k in range(MOST_PASSES))
    positions = ", ".join(f"case when {got(k)} > 0 then {_position_sql(f'{start(k)}::double / target')} end as position_{k + 1}" for k in range(MOST_PASSES))
    return f"""
    with sized as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
            md5(coalesce(doc_id::varchar, '') || ' ' || md5(coalesce(text, ''))) as h
        from documents),
    per as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
    caps as (select *, case place % {n} {case(WEIGHTS)} end as weight, ({MOST_PASSES} * source_size)::double as cap from per),
    levels as (
        select *, ((sum(source_size) over ())::double * {SHARE} - coalesce(sum(cap) over filled, 0)) / (sum(weight) over () - coalesce(sum(weight) over filled, 0)) as level
        from caps window filled as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
    lowest as (select level from levels where level * weight <= cap order by cap / weight, place limit 1),
    wanted as (
        select source, case place % {n} {case(STARTS)} end as a, case place % {n} {case(ENDS)} end as b, source_size,
            coalesce(least(cap, (select level from lowest) * weight), cap) as target
        from levels),
    placed as (
        select doc_id, size, a, b, w.source_size, target,
            coalesce(sum(size) over (partition by s.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
        from sized s join wanted w on s.source is not distinct from w.source)
    select doc_id, size, source_size, target, ({taken})::bigint as taken, {positions} from placed"""
