"""Streams: event windows with late data, counters per source, the cascade batch by batch over a growing graph."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_parquet(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windows(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums per window and type; for a stream ``late`` bounds how late rows may come. Rows without a time are left out."""
    e = events.where("ts is not null")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events with less than ``gap`` between them."""
    e = events.where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def micro_batches(ordered: DataFrame, size: int = 10, order: str = "seq") -> DataFrame:
    """The rows with the number of their batch of ``size`` in order. The order runs by range over partitions: counts of each come first, so no task sorts all rows."""
    spark = ordered.sparkSession
    from ..operators.history import segment

    s = segment(ordered.withColumn("_one", F.lit(1)), "_one", order, "batches")
    from pyspark.sql import Window

    start = s.groupBy("_seg").agg(F.count("*").alias("k"))
    before = start.select("_seg", F.coalesce(F.sum("k").over(Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row a partition
    r = F.row_number().over(Window.partitionBy("_seg").orderBy(order))
    assert spark
    return s.join(F.broadcast(before), "_seg").withColumn("batch_no", F.floor((r - 1 + F.col("b")) / size)).drop("_one", "_seg", "b")


def source_counters(facts: DataFrame) -> DataFrame:
    """(doc, total, accepted, rejected): running counters per source; in a stream in update mode."""
    return facts.groupBy(F.coalesce("doc", F.lit("unknown")).alias("doc")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def cascade(stream: DataFrame, graph_path: str, decide: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, out_path: str):
    """Start the cascade on a stream of facts: each batch is checked against the graph of the batches before, verdicts are kept, and what is accepted joins the graph.

    Both are written under the batch's number, so a batch that is run again after a failure writes the same place and reads only what came before it. ``decide``
    takes (batch, edges) and returns (seq, status, ...).
    """

    def step(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        edges = spark.read.parquet(graph_path).where(F.col("batch_no") < n).drop("batch_no")
        verdicts = decide(df, edges)
        verdicts.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_no={n}"))
        good = spark.read.parquet(os.path.join(out_path, f"batch_no={n}")).where("status = 'accepted'").select("seq")
        df.join(good, "seq", "left_semi").select(*edges.columns).write.mode("overwrite").parquet(os.path.join(graph_path, f"batch_no={n}"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
