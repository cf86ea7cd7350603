"""Settings of a site: texts as they were entered, read with their kind and range, or else their default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_PERCENT, JOB_LIMIT, SITE_LIMIT, USER_LIMIT

#: Name, default, least and greatest value, decimals. Fixed values of the data model
SETTINGS = (
    ("joblimit", JOB_LIMIT, 0, 10_000, 2),
    ("userlimit", USER_LIMIT, 0, 10_000, 2),
    ("sitelimit", SITE_LIMIT, 0, 1_000_000, 2),
    ("alertpercent", ALERT_PERCENT, 0, 100, 0),
    ("parallel", 4, 1, 6, 0),
)


def read_number(value: Column, default: float, least: float, most: float, decimals: int) -> Column:
    """A plain number within its range and with no more decimals than allowed; blanks around it don't count. Anything else is the default."""
    text = F.btrim(value)
    number = F.try_to_number(F.when(text.rlike(rf"\A[0-9]{{1,9}}{rf'(\.[0-9]{{1,{decimals}}})?' if decimals else ''}\z"), text), F.lit("999999999D999999")).cast("double")
    return F.when(number.between(least, most), number).otherwise(F.lit(float(default)))


def site_settings(rows: DataFrame, settings: tuple = SETTINGS) -> DataFrame:
    """One row per site with a column for each of ``settings``. ``rows(site, name, value)``: unknown names are ignored; of repeated ones the greatest text counts."""
    got = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return rows.groupBy("site").agg(*[read_number(got(name), *limits).alias(name) for name, *limits in settings])
