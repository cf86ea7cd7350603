"""Queries of texts give the rows of their SQL on lines that the small tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import plans
from docloom.functions import text as T
from tests.compare import difference


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compare a query with its SQL over a few texts."""

    def run(name, *texts):
        rows = [(i, text, "web") for i, text in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        n, what = difference(spark, duck, plans.QUERIES[name], plans.ORACLES[name], str(tmp_path))
        assert n and not what

    return run


def test_clean_text_keeps_line_ends_after_soft_hyphens(same_as_sql):
    same_as_sql("clean_text", *["one\nname\ntwo e\r\nthree\x07 ffi fi ß ţ\te\n"] * 5)


def test_aligned_tables_keep_pipes_in_cells(same_as_sql):
    same_as_sql("aligned_tables", "one. a | b, two\nthree. | c, |\nfour. \\|, five\nno table here", "a. b, c")


def test_headings_are_as_long_as_their_lines(same_as_sql):
    """Capitals of ß and the like are one letter each: a line of 90 is not too long, one of 91 is."""
    wide = "".join(T.WIDE_CAPITALS)
    same_as_sql("heading_levels", *[f"{'a' * n} ßẞ ŉo {tail}" for tail in ("", wide[:20], wide[20:40], wide[40:70], wide[70:]) for n in (60, 82, 83, 84, 88)] * 7)


def test_one_capital_for_each_letter(spark):
    df = spark.createDataFrame([("Straße ﬁn ǰ ᾳx ẞ i",), ("",), ("ß",), ("ßß",), (None,)], "t string")
    assert [r[0] for r in df.select(T.upper_each(F.col("t"))).collect()] == ["STRAẞE ﬁN ǰ ᾼX ẞ I", "", "ẞ", "ẞẞ", None]
