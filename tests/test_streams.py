"""Streams: states of jobs, counters on two levels, progress of posts, ingest of captures."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

from cartolake.streaming import ingest, jobs

EVENT = "ts timestamp, event_id long, job_id string, region string, status string, progress long"
DAY = dt.datetime(2024, 5, 6)


def at(hour, minute=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute)


def told(spark, root, batches, schema, make, mode="update"):
    """(rows that the stream gave, with batch_no; its progress reports); a file and a query's restart for each of batches."""
    reports = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        with jobs.state_store(spark):
            q = make(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch_no={n}")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        reports += [q.recentProgress]
    return spark.read.parquet(f"{root}/out"), reports


def last_of(rows):
    return {(r.job_id, r.region): (r.status, r.progress) for r in rows.groupBy("job_id", "region").agg(F.max_by(F.struct("status", "progress"), "batch_no").alias("x")).select("job_id", "region", "x.*").collect()}


STATES = [
    (at(1), 1, "j", None, "started", 0), (at(1, 5), 2, "j", "north", "processing", 3), (at(1, 9), 3, "j", "north", "completed", 7), (at(1, 10), 4, "j", "north", "processing", 99),
    (at(1, 20), 5, "j", "south", "failed", None), (at(2), 6, "j", None, "completed", 7), (at(2, 1), 7, "j", None, "progress", 8), (at(2, 2), 8, "k", None, "started", 0),
]


@pytest.mark.parametrize("sizes", [[8], [3, 5], [1] * 8])
def test_job_states_in_any_number_of_batches(spark, tmp_path, sizes):
    """Progress after an end is refused whether it comes with it or later, also after a restart; repeats change nothing."""
    edges = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    batches = [STATES[a:b] + STATES[a : a + 1] for a, b in zip(edges, edges[1:], strict=False)]
    rows, _ = told(spark, str(tmp_path), batches, EVENT, lambda s: jobs.live_job_state(s))
    want = {("j", ""): ("completed", 7), ("j", "north"): ("completed", 7), ("j", "south"): ("failed", None), ("k", ""): ("started", 0)}
    assert last_of(rows) == want
    table = jobs.job_states(spark.createDataFrame(STATES, EVENT))
    assert {(r.job_id, r.region): (r.status, r.progress) for r in table.collect()} == want


def test_finished_jobs_leave_the_state(spark, tmp_path):
    done = [(at(1, k), k, f"j{k}", None, "completed", k) for k in range(20)]
    later = [(at(60, k), 100 + k, "open", None, "progress", k) for k in range(2)]
    _, reports = told(spark, str(tmp_path), [done, later], EVENT, lambda s: jobs.live_job_state(s, keep_hours=2))
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in sum(reports, []) if p["stateOperators"]]
    assert max(rows) >= 20 and rows[-1] < 5, rows


class Told:
    """A job's state and timers without a stream, which count what they are asked."""

    def __init__(self):
        self.asked, self.timers, self.value, self.map = 0, set(), None, {}

    def getValueState(self, name, schema):
        return self

    getMapState = getValueState

    def counted(self, answer=None):
        self.asked += 1
        return answer

    def get(self):
        return self.counted(self.value)

    def update(self, value):
        self.value = self.counted(value)

    def clear(self):
        self.value, self.map = self.counted(), {}

    def containsKey(self, key):
        return self.counted(key in self.map)

    def getValue(self, key):
        return self.counted(self.map[key])

    def updateValue(self, key, value):
        self.map[key] = self.counted(value)

    def listTimers(self):
        return self.counted(set(self.timers))

    def registerTimer(self, at):
        self.timers.add(self.counted(at))

    def deleteTimer(self, at):
        self.timers.discard(self.counted(at))


def test_a_batch_asks_the_state_of_a_job_once_for_all_its_regions():
    own, told = jobs.JobStates(("completed",), 1000), Told()
    own.init(told)
    event = lambda region, status, at: Row(region=region, status=status, at=at, event_id=at, progress=at)
    some = lambda at, last: [event(f"r{k}", "progress", at) for k in range(20)] + [event("", last, at)]
    for at, last, most in ((1_000_000, "started", 2), (2_000_000, "completed", 3), (3_000_000, "completed", 2)):
        told.asked = 0
        assert len(list(own.handleInputRows((7,), iter(some(at, last)), None))) == 21
        assert told.asked <= most
    told.asked = 0
    assert list(own.handleInputRows((7,), iter(some(1_000_000, "progress")), None)) == [] and told.asked == 1
    # the end has moved on since the timer was set, so the job stays until the new end's time is over
    assert told.timers == {3000}
    list(own.handleExpiredTimer((7,), None, ExpiredTimerInfo(3000)))
    assert told.value is not None and told.timers == {3000, 4000}
    list(own.handleExpiredTimer((7,), None, ExpiredTimerInfo(4000)))
    assert told.value is None


def test_regions_add_up_to_jobs_in_every_batch(spark, tmp_path):
    """Repeated events count once, one that comes later than the watermark allows is left out, and windows come when they are over."""
    first = [(at(1, k), k, "j", "north" if k % 2 else None, "x", k) for k in range(10)]
    second = [(at(2, 30), 20, "j", "south", "x", 5), first[3], (at(1, 30), 21, "j", "north", "x", 100)]
    third = [(at(6), 30, "j", "south", "x", 1), (at(1, 31), 31, "j", "south", "x", 1000)]
    fourth = [(at(9), 40, "j", "south", "x", 1), (at(2, 31), 41, "j", "north", "x", 1000)]
    rows, _ = told(spark, str(tmp_path), [first, second, third, fourth], EVENT, lambda s: jobs.window_counters(s, ["progress"]), "append")
    found = rows.collect()
    for key in {(r.batch_no, r.window_start) for r in found}:
        own = [r for r in found if (r.batch_no, r.window_start) == key]
        assert sum(r.progress for r in own if r.region is None) == sum(r.progress for r in own if r.region is not None)
        assert sum(r.n_events for r in own if r.region is None) == sum(r.n_events for r in own if r.region is not None)
    by = {(r.window_start.hour, r.region): (r.n_events, r.progress) for r in found}
    assert by[1, None] == (12, sum(range(10)) + 1100) and by[2, "south"] == (1, 5) and by[2, None] == (1, 5) and by[6, None] == (1, 1)
    assert len(found) == len(by)


def test_progress_tells_the_whole_list_after_each_batch(spark, tmp_path):
    schema = "post_id string, seq long, sequence int, name string, stage string, done int"
    mention = lambda s, n: ("p", s, s, n, None, None)
    report = lambda seq, stage, done: ("p", seq, None, None, stage, done)
    batches = [[mention(2, "b"), mention(1, "a")], [report(10, "MATCH", 1), mention(3, "c"), mention(2, "other")], [report(9, "OLD", 0)], [report(12, "DONE", 9), ("q", 1, 1, "x", None, None)]]
    rows, _ = told(spark, str(tmp_path), batches, schema, jobs.live_progress)
    state = lambda n, p="p": [(r.sequence, r.name, r.status, r.stage) for r in rows.where(f"batch_no = {n} AND post_id = '{p}'").orderBy("sequence").collect()]
    assert state(0) == [(1, "a", "PENDING", ""), (2, "b", "PENDING", "")]
    assert state(1) == state(2) == [(1, "a", "DONE", "MATCH"), (2, "b", "PENDING", "MATCH"), (3, "c", "PENDING", "MATCH")]
    assert [s for _, _, s, _ in state(3)] == ["DONE"] * 3 and state(3, "q") == [(1, "x", "PENDING", "")]


CAPTURES = "capture_no long, place_id string, title string, link string, address string, rating_text string, stars array<string>, hours array<struct<label:string,cells:array<string>>>, dom array<string>"


def captures(spark, rows):
    return spark.createDataFrame(rows, CAPTURES)


def test_a_batch_that_is_killed_between_two_tables_never_shows(spark, tmp_path, monkeypatch):
    hours = [("Monday, 9 AM to 5 PM, Copy open hours", None)]
    captures(spark, [(1, "A", "Pho", "", "Address: 5", "4,5", ["5 stars, 12"], hours, ["u1"])]).write.parquet(str(tmp_path / "in"))
    root, state = str(tmp_path / "tables"), str(tmp_path / "state")
    start = lambda: ingest.ingest_places(spark.readStream.schema(CAPTURES).parquet(str(tmp_path / "in")), root, state)
    start().awaitTermination()
    captures(spark, [(2, "A", "Pho 2", "", "6", "3.5", None, None, []), (3, "B", "Bun", "", "7", None, None, hours, ["u2", "u3"]), (4, None, " ", "", None, None, None, None, None)]).write.mode("append").parquet(str(tmp_path / "in"))
    real = ingest.write_table

    def fail(rows, path):
        if "/images/" in path:
            raise RuntimeError("killed")
        real(rows, path)

    monkeypatch.setattr(ingest, "write_table", fail)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    shown = lambda t: sorted((r.batch_no, r.place_id) for r in ingest.committed(spark, root, t).collect())
    assert spark.read.parquet(f"{root}/hours").count() == 2  # the second batch's hours are there, but don't show
    assert [shown(t) for t in ("places", "hours", "images")] == [[(0, "A")]] * 3
    monkeypatch.setattr(ingest, "write_table", real)
    start().awaitTermination()
    assert shown("places") == [(0, "A"), (1, "A"), (1, "B")] and shown("hours") == [(0, "A"), (1, "B")] and shown("images") == [(0, "A"), (1, "B"), (1, "B")]
    assert [r.reject_reason for r in ingest.committed(spark, root, "rejects").collect()] == ["BLANK_TITLE"]
    now = {r.place_id: r for r in ingest.current(spark, root, "places").collect()}
    assert now["A"].title == "Pho 2" and now["A"].address == "6" and len(now) == 2
    assert [r.place_id for r in ingest.current(spark, root, "hours").collect()] == ["B"]
    first = ingest.committed(spark, root, "places").where("batch_no = 0").first()
    assert first.breakdown == {"5": 12} and first.review_count == 12 and first.open_hours == {"Monday": ["9 AM - 5 PM"]} and '"reviewRating":4.5' in first.payload


def test_captures_of_one_place_in_a_batch(spark):
    """The last capture of a place counts; missing columns are null; URLs stand in for an id."""
    rows = captures(spark, [(1, "A", "old", "", None, None, None, None, None), (2, "A", "new", "", None, None, None, None, None), (3, None, "x", "https://maps.google.com/?cid=77", None, None, None, None, None)])
    found = ingest.place_tables(ingest.judged_captures(rows))
    assert sorted((r.place_id, r.title) for r in found["places"].collect()) == [("A", "new"), ("cid:77", "x")]
    assert all(found[t].count() == 0 for t in ("hours", "popular_times", "about", "images", "rejects"))
