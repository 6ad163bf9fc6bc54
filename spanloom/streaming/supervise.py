"""A followed stream that outlives its failures.

A failing micro-batch ends a streaming query. The supervisor notes the failure as a row of
the lake, waits and starts the query again from its checkpoint, which repeats the batch.
Failures of one batch in a row are limited; a batch that got through, seen by a query
listener, starts the count anew. What has failed to the limit is noted and given up: a
poison batch ends with a row that says so and not with an endless loop.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources import lake as lakes
from .materialize import materialize

RESTARTS, FIRST_WAIT, LONGEST_WAIT = 5, 1.0, 60.0


class Progress(StreamingQueryListener):
    """The last batch of a query that got through."""

    def __init__(self):
        self.query_id: str | None = None
        self.last_batch: int | None = None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if str(event.progress.id) == self.query_id:
            self.last_batch = event.progress.batchId

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


class Supervisor:
    """Keeps one stream going until it ends by itself, is stopped, or is given up.

    start makes the streaming query. restarts bounds the failures in a row of one batch; the waits between them double from
    first_wait seconds. `given_up` holds the last error then.
    """

    def __init__(self, spark: SparkSession, lake: str, start: Callable[[], StreamingQuery], restarts: int = RESTARTS, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT):
        self.spark, self.lake, self._start = spark, lake, start
        self.restarts, self.first_wait, self.longest_wait = restarts, first_wait, longest_wait
        self.given_up: Exception | None = None
        self._stopping = threading.Event()
        self._query: StreamingQuery | None = None
        self._thread: threading.Thread | None = None

    def run(self) -> None:
        """Follow the stream here. Raises the last error when it gives up."""
        progress = Progress()
        self.spark.streams.addListener(progress)
        failures, reached = 0, None
        try:
            while not self._stopping.is_set():
                try:
                    self._query = self._start()
                    progress.query_id = str(self._query.id)
                    if self._stopping.is_set():
                        self._query.stop()
                    self._query.awaitTermination()
                    return
                except StreamingQueryException as error:
                    last = self._query.lastProgress
                    done = max((b for b in (progress.last_batch, last.batchId if last else None) if b is not None), default=None)
                    failures = failures + 1 if done == reached else 1
                    reached = done
                    give_up = failures > self.restarts
                    lakes.note_failure(self.spark, self.lake, None if done is None else done + 1, failures, str(error), give_up)
                    if give_up:
                        self.given_up = error
                        raise
                    self._stopping.wait(min(self.longest_wait, self.first_wait * 2 ** (failures - 1)))
        finally:
            self.spark.streams.removeListener(progress)

    def start(self) -> Supervisor:
        """Follow the stream in the background."""

        def follow():
            try:
                self.run()
            except StreamingQueryException:
                pass  # noted, and kept in given_up

        self._thread = threading.Thread(target=follow, daemon=True)
        self._thread.start()
        return self

    def stop(self, timeout: float | None = None) -> None:
        """End the stream. A batch that this cuts off is repeated when it is followed again."""
        self._stopping.set()
        ends = time.monotonic() + (timeout or 3600)
        while self._thread and self._thread.is_alive() and time.monotonic() < ends:
            if self._query is not None and self._query.isActive:
                self._query.stop()
            self._thread.join(0.2)


def supervise(spark: SparkSession, wal_path: str, lake: str, restarts: int = RESTARTS, first_wait: float = FIRST_WAIT, **options) -> Supervisor:
    """A supervisor, not yet started, of `materialize` with these options."""
    return Supervisor(spark, lake, lambda: materialize(spark, wal_path, lake, **options), restarts, first_wait)
