"""The call log as a stream: sums by user and hour, sessions, and reservations as they come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SITE_LIMIT
from ..operators.budget import LEDGER, Ledger
from ..operators.usage import sums


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as they come, with ``ts`` as an instant, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def usage_by_window(log: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Sums by user and window; a window is final once the watermark has passed it. ``log`` with ``ts``."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "userid").agg(*sums()).select(F.col("window.start").alias("start"), "userid", "cost", "tokensin", "tokensout", "tokenscached", "calls", "errors")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's calls with no longer pause than ``gap`` are a session."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "userid").agg(F.count(F.lit(1)).alias("calls")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "userid", "calls")


def reservations(events: DataFrame, site_limit: int = SITE_LIMIT * 1_000_000) -> DataFrame:
    """``operators.budget.reservations`` on a stream: the month's sums and open reservations are its state.

    Each micro-batch is folded in order of ``at``, ``call`` and kind; what came in an earlier one counts first.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = Ledger(site_limit)
        if state.exists:
            rows, held = json.loads(state.get[0])
            ledger.rows, ledger.open = {int(k): v for k, v in rows.items()}, {int(k): v for k, v in held.items()}
        events = pd.concat(list(batches)).sort_values(["at", "call", "kind"])
        out = [(key[0], r.userid, r.call, r.kind, *ledger.apply(r.userid, r.call, r.kind, r.amount, r.limit)) for r in events.itertuples()]
        state.update((json.dumps([ledger.rows, ledger.open]),))
        yield pd.DataFrame(out, columns=["period", "userid", "call", "kind", "outcome", "spent", "reserved"])

    return events.groupBy("period").applyInPandasWithState(fold, LEDGER, "ledger string", "append", GroupStateTimeout.NoTimeout)


def drained(rows: DataFrame, folder: str) -> DataFrame:
    """Run the stream over what there is now and return its result so far, which each batch writes anew to ``folder``."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
    rows.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")
