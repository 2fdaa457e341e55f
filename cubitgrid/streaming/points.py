"""Scenarios that arrive as a stream of points: each batch is a run of its own, since scenarios are independent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cubitgrid.plans import settings as S
from cubitgrid.plans.run import Run

POINT = "scenario_id bigint, point_id bigint, x bigint, y bigint"


def measure_stream(points: DataFrame, source: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], settings: S.Settings | None = None, once: bool = False) -> StreamingQuery:
    """Start a query that gives sink(boundaries, batch_id) for every batch of points; a replayed batch has its old id,
    so a sink that overwrites by batch_id holds each batch once."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            sink(Run(rows.sparkSession, source, rows, settings=settings).result(), batch_id)

    writer = points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
