"""Aggregations of a cube whose facts arrive as a stream.

The cube's cells, drilldowns and aggregates apply as they do to tables; events
are grouped by windows of event time as well, and a watermark bounds how long
late events are waited for, and with it the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import aggregates as functions
from ..operators.browser import Browser
from ..plans.drilldown import Drilldown


class LiveCube:
    """``browser`` describes the cube; its fact table is a streaming DataFrame, its details are static tables."""

    def __init__(self, browser: Browser, time_column: str, delay: str = "10 minutes"):
        self.browser, self.time_column, self.delay = browser, time_column, delay

    def aggregate(self, window: str, slide: str | None = None, cell=None, aggregates=None, drilldown=None) -> DataFrame:
        """Cells per window of time: window_start, window_end, the drilled attributes and the aggregates. For ``writeStream`` in append or update mode."""
        b = self.browser
        cell = b.cell(cell)
        chosen = b.prepare_aggregates(aggregates)
        if exact := [a.name for a in chosen if a.function and functions.canonical(a.function) == "count_distinct"]:
            raise ArgumentError(f"streams have no exact distinct counts: {exact}")
        drill = Drilldown(drilldown, cell)
        star = b.star
        fact = star.table(star.fact_name)
        star._frames[star.fact_name] = fact.withWatermark(self.time_column, self.delay)
        try:
            df = star.frame([*drill.attributes, *star.cell_attributes(cell), *b._aggregate_inputs(chosen)])
        finally:
            star._frames[star.fact_name] = fact
        condition = star.condition(cell)
        df = df.where(condition) if condition is not None else df
        time = F.col(f"`{star.fact_name}`.`{self.time_column}`")
        span = F.window(time, window, slide) if slide else F.window(time, window)
        made = [c.alias(n) for n, c in b.aggregate_columns(chosen).items()]
        out = df.groupBy(span.alias("__window__"), *(star.column(a).alias(a.ref) for a in drill.attributes)).agg(*made)
        return out.select(F.col("__window__.start").alias("window_start"), F.col("__window__.end").alias("window_end"), *(F.col(f"`{a.ref}`") for a in drill.attributes), *(F.col(f"`{a.name}`") for a in chosen))

    def sessions(self, by: str, gap: str, cell=None) -> DataFrame:
        """Sessions of each member of a flat dimension: runs of events with no gap longer than ``gap``, with their start, end and number of events."""
        b = self.browser
        cell = b.cell(cell)
        key = b.cube.dimension(by).levels[0].key
        star = b.star
        fact = star.table(star.fact_name)
        star._frames[star.fact_name] = fact.withWatermark(self.time_column, self.delay)
        try:
            df = star.frame([key, *star.cell_attributes(cell)])
        finally:
            star._frames[star.fact_name] = fact
        condition = star.condition(cell)
        df = df.where(condition) if condition is not None else df
        time = F.col(f"`{star.fact_name}`.`{self.time_column}`")
        out = df.groupBy(star.column(key).alias(key.ref), F.session_window(time, gap).alias("__session__")).agg(F.count(F.lit(1)).alias("events"))
        return out.select(F.col(f"`{key.ref}`"), F.col("__session__.start").alias("session_start"), F.col("__session__.end").alias("session_end"), "events")
