"""Queries of the streaming operators, run over tables at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from ..runtime import table
from ..streaming import stream
from .sql import FACTS, with_

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    return stream.windows(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b
 FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    return stream.sessions(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(with_(FACTS) + "SELECT seq, (floor((row_number() OVER (ORDER BY seq) - 1) / 10))::BIGINT AS batch_no FROM facts WHERE batch_id > 0")
def stream_micro_batches(spark, d):
    return stream.micro_batches(kg.facts(spark, d).where("batch_id > 0").select("seq"))


@query(with_(FACTS) + "SELECT coalesce(doc, 'unknown') AS doc, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM facts GROUP BY 1")
def stream_source_counters(spark, d):
    return stream.source_counters(kg.facts(spark, d))
