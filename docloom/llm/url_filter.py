"""URL filters through Bloom filter cascades.

A rule list is a set of keys ``host + path``. Level 1 of a cascade is a Bloom filter of
the listed keys. Level 2 holds the keys of the corpus that level 1 takes for listed but
are not, level 3 the listed keys that level 2 takes for unlisted, and so on until a
level makes no mistake. A key's first level to miss it then tells, without error for any
key of the corpus, whether it is listed; no join touches the pages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, materialize

#: Largest filter, in bits: 1 MB goes to each task. Longer lists take several passes.
MAX_FILTER_BITS = 1 << 23


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table of one row with its 64-bit words, and its shape."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        words, found = self.words.scalar(), F.lit(True)
        for i in range(self.hashes):
            at = _position(key, self.seed + i, self.bits)
            found = found & (F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


def _position(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


def build_level(keys: DataFrame, bits: int, hashes: int, seed: int) -> Level:
    """The Bloom filter of the column ``key``; words of 64 positions are or-ed before the shuffle."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), seed + i, bits) for i in range(hashes)])).alias("at"))
    some = at.groupBy((F.col("at") / 64).cast("long").alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("word"))
    every = spark.range(math.ceil(bits / 64)).join(some, "id", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w"))
    return Level(materialize(row.select(F.col("w.word").alias("words")), "bloom"), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """True for listed keys; exact for every key of the universe it was built on."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed([*enumerate(self.levels)]):
            out = F.when(~level.has(key), F.lit(n % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, first: Level, suspects: DataFrame) -> Cascade:
    """``first``: a filter of ``listed``; ``suspects``: the universe's keys that pass it."""
    levels = [first]
    inside, outside = listed, suspects.join(listed, "key", "left_anti")
    made = []
    while True:
        outside = materialize(outside, "cascade")
        made.append(outside)
        n = outside.count()
        if not n:
            break
        level = build_level(outside, 64 * math.ceil(n * 8 / 64), 4, 1000 * len(levels))
        levels.append(level)
        inside, outside = outside, inside.where(level.has(F.col("key")))
    for df in made:
        forget(df)
    return Cascade(tuple(levels))


def _candidate(shape: tuple[int, int]) -> tuple[Column, Column]:
    """The key that a rule of ``shape`` (labels of the host, characters of the path) would need, or null; its host's length."""
    labels, chars = shape
    host = F.substring_index("host", ".", -labels)
    fits = (F.size(F.split("host", r"\.", -1)) >= labels) & (F.length("path") >= chars)
    return F.when(fits, F.concat(host, F.substring("path", 1, chars))), F.length(host)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rules(host, path, action)``: action is ``allow`` or ``block``. A rule fits its host and
    its subdomains where the path starts with the rule's. The longest key wins, of equal
    ones that with the longer host, of the same key listed twice ``block``. Where none fits,
    ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://`` have an
    empty host and path. Repeated rows stay; other columns are dropped; an empty table gives
    no rows. Rules with a null in any column, or an empty host, are ignored.

    One scan reads the urls to find false positives of the first levels, another judges.
    A list that needs more than ``max_filter_bits`` is split by key hash into parts of at
    most that size, each applied in a pass of its own, so what a task holds stays bounded.
    """
    rules = rules.where("host <> '' and path is not null and action in ('allow', 'block')")
    keys = rules.select(F.concat("host", "path").alias("key"), "action", F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars"))
    # as many shapes as rules differ in host depth and path length, not as rules
    shapes = sorted(tuple(r) for r in keys.select("labels", "chars").distinct().collect())
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    best = F.lit(None).cast("struct<n:int,h:int,block:int,rule:string>")
    if shapes:
        n_keys, n_urls = keys.count(), pages.count()
        per_key = math.log2(2 + len(shapes) * n_urls / n_keys) / math.log(2)
        parts = math.ceil(n_keys * per_key / max_filter_bits)
        universe = urls.select(F.explode(F.array_compact(F.array(*[_candidate(s)[0] for s in shapes]))).alias("key"))
        for part in range(parts):
            own = lambda key: F.pmod(F.xxhash64(key), F.lit(parts)) == part  # noqa: E731, B023
            cascades = {}
            for seed, action in enumerate(("allow", "block")):
                listed = keys.where((F.col("action") == action) & own(F.col("key"))).select("key").distinct()
                if n := listed.count():
                    first = build_level(listed, 64 * math.ceil(n * per_key / 64), max(1, round(per_key * math.log(2))), 100_000 * (seed + 1))
                    cascades[action] = (listed, first)
            if not cascades:
                continue
            passing = F.lit(False)
            for _, first in cascades.values():
                passing = passing | first.has(F.col("key"))
            suspects = materialize(universe.where(own(F.col("key")) & passing).distinct(), "suspects")
            built = {a: build_cascade(listed, first, suspects.where(first.has(F.col("key")))) for a, (listed, first) in cascades.items()}
            hits = [best]
            for shape in shapes:
                key, host_chars = _candidate(shape)
                for action, cascade in built.items():
                    hit = key.isNotNull() & own(key) & cascade.has(key)
                    hits.append(F.when(hit, F.struct(F.length(key).alias("n"), host_chars.alias("h"), F.lit(int(action == "block")).alias("block"), key.alias("rule"))))
            urls = urls.withColumn("best", F.greatest(*hits))
            if parts > 1:
                urls = materialize(urls, "judged")
            best = F.col("best")
    found = urls.withColumn("best", best)
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block") == 1, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
