"""Phases 1 to 4 on a stream: they look at one row at a time, and imputation uses a plan made on a batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sluice.plans.pipeline import row_local
from sluice.plans.policy import Policy


class _Progress(StreamingQueryListener):
    """Tells a caller of every batch: its number, its rows, and all rows so far."""

    def __init__(self, told: Callable[[int, int, int], None]):
        self.told, self.rows = told, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.told(event.progress.batchId, event.progress.numInputRows, self.rows)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def correct_stream(
    stream: DataFrame, policy: Policy, output: str, audit: str, checkpoint: str, steps: list[dict[str, Any]] | None = None, clock: str = "", progress: Callable[[int, int, int], None] | None = None
) -> StreamingQuery:
    """Starts a query that takes what is available, then ends. The stream has a row id column.

    Each micro-batch writes corrected rows and audit events, those of validity rules included, to folders of its own
    number, so a batch that runs again after a failure replaces its earlier files. ``progress`` is called after every
    batch with its number, its rows and all rows so far.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = row_local(batch, policy, steps, clock)
        found.rows = found.rows.persist()
        try:
            found.table().write.mode("overwrite").parquet(f"{output}/batch={number}")
            found.events().write.mode("overwrite").json(f"{audit}/batch={number}")
        finally:
            found.rows.unpersist()

    if progress is not None:
        stream.sparkSession.streams.addListener(_Progress(progress))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
