"""The call log as it is written: a row for every attempt, once, however often a batch or an attempt comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What identifies an attempt.
ATTEMPT = ["call", "attempt"]


def log_rows(attempts: DataFrame) -> DataFrame:
    """Rows of the log for ``attempts(call, attempt, ts, userid, jobid, step, connector, billed, durationms, error, httpstatus)``.

    ``billed`` is ``struct<connector, model, tokensin, tokensout, tokenscached, cost>`` of what the provider charged, also for an answer that was then
    refused, and null if nothing was; what it lacks is 0, and the connector's name is the configured one. No status of HTTP is null.
    Attempts without a user are not logged.
    """
    billed = lambda c: F.coalesce(F.col(f"billed.{c}"), F.lit(0)).alias(c)
    rows = attempts.where("userid is not null")
    tokens = [billed(c) for c in ("tokensin", "tokensout", "tokenscached")]
    cost = F.coalesce(F.col("billed.cost"), F.lit(0)).cast("decimal(12,6)").alias("cost")
    status = F.when(F.coalesce("error", F.lit(False)), "error").otherwise("success").alias("status")
    names = [F.coalesce("billed.connector", "connector", F.lit("")).alias("connector"), F.coalesce("billed.model", F.lit("")).alias("model")]
    return rows.select(*ATTEMPT, "ts", "userid", "jobid", "step", *names, *tokens, cost, "durationms", status, F.nullif("httpstatus", F.lit(0)).alias("httpstatus"))


def append(attempts: DataFrame, folder: str, late: str = "1 hour") -> DataFrame:
    """Write the stream of attempts that are there now to ``folder`` and read the log so far.

    A batch that runs again after a failure overwrites what it wrote before, as its number is in its folder's
    name. An attempt that the source sends again within ``late`` is dropped by its key, with a state that the watermark bounds.
    """
    rows = log_rows(attempts).withWatermark("ts", late).dropDuplicatesWithinWatermark(ATTEMPT)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/log")
