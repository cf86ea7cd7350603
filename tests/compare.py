"""Compare queries with their SQL: ``python -m tests.compare SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 4) -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    out.execute("set timezone = 'UTC'")
    for name in TABLES:
        out.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return out


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows(names: list[str], values: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def difference(spark: SparkSession, duck: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Rows of the query, and what differs ('' if nothing)."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    made = duck.execute(sql)
    want = rows([d[0] for d in made.description], made.fetchall())
    if got == want:
        kinds = {str(d[1]) for d in duck.execute(sql).description} & {"HUGEINT", "DECIMAL"}
        return len(got[1]), f"types {kinds}" if kinds else ""
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} {want[0]}"
    extra, lost = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
    return len(got[1]), f"{len(got[1])} rows, wanted {len(want[1])}; got {extra}; wanted {lost}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, sf_dir, names = session(), sys.argv[1], sys.argv[2:]
    duck, every, sql = connection(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or every:
        began = time.time()
        try:
            if name in sql:
                n, what = difference(spark, duck, every[name], sql[name], sf_dir)
            else:
                n, what = every[name](spark, sf_dir).count(), ""
            print("DIFFERS" if what else "same" if name in sql else "rows", name, n, f"{time.time() - began:.1f} s", what, flush=True)
        except Exception as error:
            print("FAILS", name, f"{type(error).__name__}: {str(error)[:1500]}", flush=True)
