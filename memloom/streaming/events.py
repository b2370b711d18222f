"""Listeners of the ingest: callbacks for new messages and for the end of a sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


class Events:
    """Callbacks by event name; one that fails doesn't keep the others from being called, nor the batch from its end."""

    NAMES = ("new_message", "sync_complete")

    def __init__(self) -> None:
        self.known: dict[str, list[Callable]] = {n: [] for n in self.NAMES}
        self.failed: list[tuple[str, Exception]] = []

    def on(self, name: str, call: Callable) -> None:
        self.known[name].append(call)

    def off(self, name: str, call: Callable) -> None:
        self.known[name].remove(call)

    def emit(self, name: str, *args: object) -> None:
        for call in list(self.known[name]):
            try:
                call(*args)
            except Exception as e:
                self.failed.append((name, e))

    def after(self, batch: DataFrame, k: int) -> None:
        """For ingest.run(after=...): new_message gets each batch's messages, distributed as they are."""
        self.emit("new_message", batch, k)


class Progress(StreamingQueryListener):
    """Emits sync_complete with the rows of each batch that had any."""

    def __init__(self, events: Events):
        self.events = events

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        if event.progress.numInputRows:
            self.events.emit("sync_complete", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass
