"""Lists inside activities: entries whose titles repeat, chapters of books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_name


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Glossary entries or wiki pages: of equal titles, whatever their case, the first; none without a title. ``entries(owner, pos, title)``."""
    rows = entries.withColumn("title", clean_name(F.col("title"))).where("title <> ''")
    nth = F.row_number().over(Window.partitionBy("owner", F.lower("title")).orderBy("pos"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def chapters(rows: DataFrame) -> DataFrame:
    """``owner, page, title, sub``: chapters numbered from 1; the first is no sub-chapter. ``rows(owner, pos, title, sub)``."""
    page = F.row_number().over(Window.partitionBy("owner").orderBy("pos"))
    return rows.withColumn("page", page).select("owner", "page", clean_name(F.col("title")).alias("title"), (F.coalesce("sub", F.lit(False)) & (F.col("page") > 1)).alias("sub"))
