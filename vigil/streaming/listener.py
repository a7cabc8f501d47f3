"""Progress of streaming queries."""

from __future__ import annotations

import logging
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

logger = logging.getLogger(__name__)


class BatchInfo(StreamingQueryListener):
    """Logs every batch and keeps the last ``keep`` as (query, batch, rows, ms)."""

    def __init__(self, keep: int = 100):
        super().__init__()
        self.batches: deque[tuple[str, int, int, int]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        logger.info("query %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, p.batchDuration))
        logger.info("query %s batch %s: %s rows", p.id, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        logger.info("query %s idle", event.id)

    def onQueryTerminated(self, event) -> None:
        logger.info("query %s ended: %s", event.id, event.exception)


class BatchTable(BatchInfo):
    """Batch progress as rows of a table in a shared folder.

    Progress is collected as it comes and written by ``flush``, as a listener must not
    hold up the queries it hears of.  Only batches that read rows are kept.
    """

    SCHEMA = "query_id string, batch_id long, rows long, duration_ms long"

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append what has come since the last call; returns how many batches that were."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = []
        while self.batches:
            batch = self.batches.popleft()
            if batch[2]:
                rows.append(batch)
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(path)
        return len(rows)
