"""Prices, peak hours and token estimates as expressions. Amounts are decimals, rounded once, half up, to micro-dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BYTES_PER_TOKEN, KINDS, OUTPUT_LIMIT_DEFAULT, OUTPUT_LIMIT_MOST, OUTPUT_LIMITS, PEAK_WINDOWS


def is_peak(epoch: Column, windows: tuple[tuple[int, int, int], ...] = PEAK_WINDOWS) -> Column:
    """True if the UTC weekday and hour are within one of the windows (ISO weekday, first hour, hour after)."""
    at = F.timestamp_seconds(epoch)
    day, hour = F.weekday(at) + 1, F.hour(at)
    out = F.lit(False)
    for d, start, end in windows:
        out = out | ((day == d) & (hour >= start) & (hour < end))
    return out


def next_offpeak(epoch: Column, windows: tuple[tuple[int, int, int], ...] = PEAK_WINDOWS) -> Column:
    """The first of the next 168 whole hours from ``epoch`` on that is off-peak; ``epoch`` if none is."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(167)), lambda h: epoch + h * 3600)
    return F.coalesce(F.get(F.filter(hours, lambda t: ~is_peak(t, windows)), F.lit(0)), epoch)


def cost(prices: dict[str, Column], tokensin: Column, tokensout: Column, tokenscached: Column, tokenswritten: Column | None = None) -> Column:
    """USD of a call: prices (USD per million tokens, decimals) of input misses, hits, output and cache writes (as misses if there is none)."""
    tokens = lambda c: c.cast("decimal(12,0)")
    total = tokens(tokensin) * prices["input_miss"] + tokens(tokenscached) * prices["input_hit"] + tokens(tokensout) * prices["output"]
    if tokenswritten is not None:
        total = total + tokens(tokenswritten) * F.coalesce(prices["cache_write"], prices["input_miss"])
    micro = F.round(total, 0).cast("decimal(18,0)")
    return F.coalesce((micro * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))


def bytes_per_token(mimetype: Column, filename: Column) -> Column:
    """By kind of file, the first that fits."""
    name = F.lower(F.concat(mimetype, F.lit(" "), filename))
    out = F.when(F.lit(False), 0)
    for needle, size in KINDS:
        out = out.when(name.contains(needle), size)
    return out.otherwise(BYTES_PER_TOKEN)


def source_tokens(tokencount: Column, filesize: Column, mimetype: Column, filename: Column) -> Column:
    """The counted tokens, else at least one by the file's size."""
    guess = F.greatest(F.lit(1), F.ceil(filesize / bytes_per_token(mimetype, filename)))
    return F.coalesce(tokencount, guess).cast("long")


def duration_minutes(brief: Column, prompt: Column) -> Column:
    """Minutes asked for: the brief's, else the first figure with minutes or hours in the prompt, else 0."""
    briefed = F.coalesce(F.get_json_object(brief, "$.duration_minutes").try_cast("int"), F.lit(0))
    pattern = r"(?i)(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?)\s*(?:de\s+)?(minutes|minute|min|hours|hour|ore|oră|ora)(?![\p{L}0-9])"
    figure = F.replace(F.regexp_extract(prompt, pattern, 1), F.lit(","), F.lit(".")).try_cast("decimal(12,4)")
    minutes = F.lower(F.regexp_extract(prompt, pattern, 2)).startswith("min")
    asked = F.round(figure * F.when(minutes, 1).otherwise(60), 0).cast("int")
    return F.when(briefed > 0, briefed).otherwise(F.coalesce(asked, F.lit(0)))


def node_count(minutes: Column, default: int = 240, per_section: int = 45, least: int = 3, most: int = 10) -> Column:
    """Sections expected of a course, and half as many subsections."""
    wanted = F.when(minutes > 0, minutes).otherwise(default)
    sections = F.greatest(F.lit(least), F.least(F.lit(most), F.round(wanted.cast("decimal(12,0)") / per_section, 0).cast("int")))
    return (sections + F.floor(sections / 2)).cast("int")


def output_limit(step: Column, configured: Column) -> Column:
    """Tokens that a call may write: the setting if positive, else the step's default, at most what any provider takes."""
    default = F.when(F.lit(False), 0)
    for name, limit in OUTPUT_LIMITS.items():
        default = default.when(step == name, limit)
    return F.least(F.lit(OUTPUT_LIMIT_MOST), F.when(configured > 0, configured).otherwise(default.otherwise(OUTPUT_LIMIT_DEFAULT))).cast("int")


def routed(own: Column, default: Column, last: str) -> Column:
    """The first of a step's own setting, the default setting and a constant that isn't blank."""
    blank = lambda c: F.nullif(F.btrim(c), F.lit(""))
    return F.coalesce(blank(own), blank(default), F.lit(last))


def provider_usage(provider: Column, usage: Column) -> Column:
    """``tokensin`` (not from the cache), ``tokensout``, ``tokenscached`` of a provider's usage object (JSON text)."""
    n = lambda key: F.coalesce(F.get_json_object(usage, f"$.{key}").try_cast("long"), F.lit(0))
    uncached = F.coalesce(F.get_json_object(usage, "$.prompt_cache_miss_tokens").try_cast("long"), F.greatest(F.lit(0), n("prompt_tokens") - n("prompt_cache_hit_tokens")))
    shape = lambda a, b, c: F.struct(a.cast("long").alias("tokensin"), b.cast("long").alias("tokensout"), c.cast("long").alias("tokenscached"))
    return (
        F.when(provider == "deepseek", shape(uncached, n("completion_tokens"), n("prompt_cache_hit_tokens")))
        .when(provider == "anthropic", shape(n("input_tokens") + n("cache_creation_input_tokens"), n("output_tokens"), n("cache_read_input_tokens")))
        .when(provider == "gemini", shape(F.greatest(F.lit(0), n("promptTokenCount") - n("cachedContentTokenCount")), n("candidatesTokenCount"), n("cachedContentTokenCount")))
        .otherwise(shape(n("prompt_tokens"), n("completion_tokens"), F.lit(0)))
    )


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[ \t]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z"), F.lit(False))
