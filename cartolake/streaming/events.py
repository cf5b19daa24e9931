"""Operators over streams of events: each once, and the guard against blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues


def dedupe_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once: senders repeat what they couldn't confirm."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def live_counters(stream: DataFrame) -> DataFrame:
    """Per job the events and imports so far, for update or complete mode."""
    return stream.groupBy("job_id").agg(F.count("*").alias("n_events"), F.sum("imported").alias("imported"))


class Streaks(StatefulProcessor):
    """The streak of a worker; without a streak there is nothing to keep."""

    def __init__(self, waits: tuple[int, ...], free: int) -> None:
        self.waits, self.free = waits, free

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = streak = self.streak.get()[0] if self.streak.exists() else 0
        for r in sorted(rows, key=lambda r: r.seq):
            streak = streak + 1 if r.blocked else streak if r.raised else 0
            at = streak - self.free - 1
            wait = self.waits[at] if r.blocked and 0 <= at < len(self.waits) else None
            yield Row(worker=key[0], seq=r.seq, streak=streak, wait_s=wait, stop=bool(r.blocked and at >= len(self.waits)))
        if streak:
            self.streak.update((streak,))
        elif before:
            self.streak.clear()

    def close(self) -> None:
        pass


def live_block_guard(stream: DataFrame, waits: tuple[int, ...] = (60, 300, 900), free: int = 1) -> DataFrame:
    """block_streaks as a stateful operator: worker, seq, streak, wait_s, stop for a stream (worker long, seq long, blocked, raised).

    The state of a worker is its streak, and goes with it: only workers that are blocked just now are kept. Within a batch
    rows go by seq. Start the query within jobs.state_store().
    """
    return stream.groupBy("worker").transformWithState(Streaks(waits, free), "worker long, seq long, streak long, wait_s long, stop boolean", "Append", "None")
