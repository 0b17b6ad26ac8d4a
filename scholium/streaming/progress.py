"""What streams do, as a queue that the caller drains."""

from __future__ import annotations

import queue
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass(frozen=True)
class Event:
    """kind: started, progress or ended; rows and batch of a progress, the error of an end."""

    kind: str
    query: str
    batch: int | None = None
    rows: int | None = None
    error: str | None = None


class Progress(StreamingQueryListener):
    """Register with spark.streams.addListener; the queue holds at most `most` events, the latest."""

    def __init__(self, most: int = 10_000):
        self._events: queue.Queue = queue.Queue(maxsize=most)

    def _put(self, event: Event) -> None:
        while True:
            try:
                return self._events.put_nowait(event)
            except queue.Full:
                self._events.get_nowait()

    def drain(self) -> Iterator[Event]:
        """The events so far, each given once."""
        while True:
            try:
                yield self._events.get_nowait()
            except queue.Empty:
                return

    def onQueryStarted(self, event) -> None:
        self._put(Event("started", str(event.id)))

    def onQueryProgress(self, event) -> None:
        self._put(Event("progress", str(event.progress.id), event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        """Nothing is done."""

    def onQueryTerminated(self, event) -> None:
        self._put(Event("ended", str(event.id), error=event.exception))
