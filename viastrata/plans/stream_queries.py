"""Queries of event windows, which streams and tables share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import closures
from . import fixtures as X
from .registry import query


def closures_of(spark, d):
    """(ts, node_id) of events that close a node of the derived city."""
    n = X.node_count(spark, d)
    return X.read(spark, d, "events").where("event_type = 'error'").select("ts", (F.col("user_id") % n).cast("long").alias("node_id"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS scenario, (user_id % n)::BIGINT AS node_id, count(*) AS n FROM events, city_size WHERE event_type = 'error' GROUP BY 1, 2""")
def x01_closed_nodes(spark, d):
    closed = closures.closed_nodes(closures_of(spark, d), "1 day")
    return closed.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("scenario"), "node_id", "n")
