"""Streams of road closures: which nodes are closed in each window of time, and what that does to a graph.

An extension: events close a node when they come, for a window of event time; late ones count up to the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resilience


def closed_nodes(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, node_id, n) of events (ts, node_id), tumbling or sliding; streaming or not."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return seen.groupBy(frame.alias("w"), "node_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "node_id", "n")


def as_scenarios(closed: DataFrame, least: int = 1) -> DataFrame:
    """(scenario, node_id): a scenario for each window's start."""
    return closed.where(F.col("n") >= least).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("scenario"), "node_id")


def on_batch(nodes: DataFrame, edges: DataFrame, od: DataFrame, sink: Callable[[DataFrame, int], None], least: int = 1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on closed_nodes in append mode: simulates each finished window and hands the results to the sink."""

    def run(batch: DataFrame, number: int) -> None:
        cases = as_scenarios(batch, least)
        if not cases.isEmpty():
            sink(resilience.simulate(nodes, edges, cases, od), number)

    return run
