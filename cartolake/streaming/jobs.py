"""Crawl jobs as streams: the state of jobs and their regions, counters on two levels, progress of posts."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Statuses after which progress doesn't count any more.
TERMINAL = ("completed", "failed", "cancelled")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which arbitrary state needs; the session's setting comes back."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


class JobStates(StatefulProcessor):
    """The units of a job, which are the job itself (region "") and its regions, each with the event that counts.

    That is the last one by time and event_id; once a terminal status has come, the last of such, so progress that comes
    later, or again, is refused. A finished job leaves the state `keep_ms` after its end, by the watermark.

    A job's units are one value, which a batch reads once and writes once if they changed, since every call of the state
    costs more than the rows do. A job has one timer at most; where its end has moved on by then, the timer is set again.
    """

    def __init__(self, terminal: tuple[str, ...], keep_ms: int) -> None:
        self.terminal, self.keep_ms = terminal, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "units array<struct<region string, status string, at long, event_id long, progress long>>, timed boolean")

    def rank(self, status: str | None, at: int, event_id: int) -> tuple[bool, int, int]:
        return (status or "").lower() in self.terminal, at, event_id

    def known(self) -> tuple[dict[str, tuple], bool]:
        """(units by region, whether a timer is set) of the job."""
        units, timed = self.job.get() or ((), False)
        return {region: tuple(own) for region, *own in units}, timed

    def forget_at(self, units: dict[str, tuple]) -> int | None:
        """When a finished job leaves the state, in milliseconds."""
        end = units.get("")
        return end[1] // 1000 + self.keep_ms if end and self.rank(*end[:3])[0] else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        best: dict[str, tuple] = {}
        for r in rows:
            own = (r.status, r.at, r.event_id, r.progress)
            if r.region not in best or self.rank(*own[:3]) > self.rank(*best[r.region][:3]):
                best[r.region] = own
        units, timed = self.known()
        changed = [(region, own) for region, own in sorted(best.items()) if region not in units or self.rank(*own[:3]) > self.rank(*units[region][:3])]
        if not changed:
            return
        units |= dict(changed)
        forget = self.forget_at(units)
        if forget is not None and not timed:
            self.handle.registerTimer(forget)
        self.job.update(([(region, *own) for region, own in sorted(units.items())], timed or forget is not None))
        for region, own in changed:
            yield Row(job_id=key[0], region=region, status=own[0], at=own[1], progress=own[3])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        forget = self.forget_at(self.known()[0])
        if forget is not None and forget > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(forget)
        else:
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def by_unit(events: DataFrame) -> DataFrame:
    """job_id, region ("" for the job itself), status, ts, at (its microseconds), event_id, progress; rows without a job or a time go."""
    known = events.where(F.col("job_id").isNotNull() & F.col("ts").isNotNull())
    return known.select("job_id", F.coalesce("region", F.lit("")).alias("region"), "status", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), F.col("progress").cast("long").alias("progress"))


def live_job_state(stream: DataFrame, terminal: tuple[str, ...] = TERMINAL, late: str = "1 hour", keep_hours: int = 24) -> DataFrame:
    """job_id, region, status, updated_at, progress of every unit whose state changed, in update mode.

    stream: ts, event_id, job_id, region (null for the job), status, progress. Events more than `late` behind the newest
    are dropped. A finished job is forgotten `keep_hours` after its end: what comes for it after that starts it anew, so
    keep_hours must exceed the time in which senders repeat. Start the query within state_store().
    """
    own = by_unit(stream).withWatermark("ts", late)
    job = own.schema["job_id"].dataType.simpleString()
    changed = own.groupBy("job_id").transformWithState(JobStates(terminal, keep_hours * 3_600_000), f"job_id {job}, region string, status string, at long, progress long", "Update", "EventTime")
    return changed.select("job_id", "region", "status", F.timestamp_micros("at").alias("updated_at"), "progress")


def job_states(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The same of a table of events: one row a unit."""
    over = F.coalesce(F.lower("status").isin(*terminal), F.lit(False))
    last = F.max_by(F.struct("status", "ts", "progress"), F.struct(over, "ts", "event_id"))
    return by_unit(events).groupBy("job_id", "region").agg(last.alias("last")).select("job_id", "region", "last.status", F.col("last.ts").alias("updated_at"), "last.progress")


def window_counters(stream: DataFrame, counters: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, job_id, region, n_events and the sums of counters, for append mode: once for each window that is over, its
    regions and, where region is null, the job's total of them.

    Two stateful steps in a row: events (ts, event_id, job_id, region) are counted once each by region, and the regions'
    windows are then summed by job and come with it, so in every batch regions add up to their job. An event that is sent
    again within `late` is dropped, as is one that is later than that. Events without a region count for the region "".
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    sums = [F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in counters]
    regions = once.groupBy(F.window("ts", window).alias("w"), "job_id", F.coalesce("region", F.lit("")).alias("region")).agg(F.count("*").alias("n_events"), *sums)
    names = ["n_events", *counters]
    total = [F.sum(c).alias(c) for c in names]
    # a job has as many rows in a window as it has regions
    jobs = regions.groupBy(F.window(F.window_time("w"), window).alias("w"), "job_id").agg(*total, F.array_sort(F.collect_list(F.struct("region", *names))).alias("regions"))
    job_row = F.struct(F.lit(None).cast("string").alias("region"), *names)
    return jobs.select(F.col("w.start").alias("window_start"), "job_id", F.inline(F.concat(F.array(job_row), "regions")))


class PostProgress(StatefulProcessor):
    """The mentions of a post in the order of their sequence, and how many of them are done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mentions = handle.getListState("mentions", "sequence int, name string")
        self.done = handle.getValueState("done", "done int, stage string, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        listed = {s: n for s, n in (self.mentions.get() if self.mentions.exists() else ())}
        done, stage, seq = self.done.get() if self.done.exists() else (0, "", -1)
        before = dict(listed)
        for r in rows:
            if r.sequence is not None:
                listed.setdefault(r.sequence, r.name)
            if r.done is not None and r.seq > seq:
                done, stage, seq = r.done, r.stage or "", r.seq
        if listed != before:
            self.mentions.put(sorted(listed.items()))
        self.done.update((done, stage, seq))
        for at, (sequence, name) in enumerate(sorted(listed.items())):
            yield Row(post_id=key[0], seq=seq, stage=stage, sequence=sequence, name=name, status="DONE" if at < done else "PENDING", n_done=min(done, len(listed)), n_pending=max(0, len(listed) - done))

    def close(self) -> None:
        pass


def live_progress(stream: DataFrame) -> DataFrame:
    """The whole list of a post's mentions at each of its reports, in update mode: post_id, seq, stage, sequence, name,
    status (the first done ones DONE, the others PENDING), n_done, n_pending.

    stream: post_id, seq (number of the report), sequence and name of a mention, or stage and done of a report. Mentions
    may come in any number of batches; of a repeated sequence the first name stays; of the reports the one of the largest
    seq counts, so a repeated or late one changes nothing. Start the query within state_store().
    """
    own = stream.where("post_id IS NOT NULL").select("post_id", F.col("seq").cast("long").alias("seq"), F.col("sequence").cast("int").alias("sequence"), "name", "stage", F.col("done").cast("int").alias("done"))
    post = own.schema["post_id"].dataType.simpleString()
    return own.groupBy("post_id").transformWithState(PostProgress(), f"post_id {post}, seq long, stage string, sequence int, name string, status string, n_done int, n_pending int", "Update", "None")
