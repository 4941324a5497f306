"""Streams of several batches, stopped and started again, against plain loops."""

import datetime
import random

import pytest

from loomline.streaming import stateful, streams

BASE = datetime.datetime(2024, 1, 1)


class Feed:
    """A folder to which files are added, and streams over it of one file a batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/part={self.n}")
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.path)


def at(minutes):
    return BASE + datetime.timedelta(minutes=minutes)


EVENTS = "id long, ts timestamp, user_id long, event_type string, value double"


def events(r, n):
    minutes = sorted(r.randint(0, 6000) for _ in range(n))
    return [(i, at(m), 0 if r.random() < 0.4 else r.randrange(4), r.choice("ab"), float(r.randint(0, 9))) for i, m in enumerate(minutes)]


def feed(spark, path, rows, batches, schema=EVENTS):
    f = Feed(spark, path, schema)
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        f.add(rows[i : i + step])
    return f


def test_update_mode_keeps_all_keys(spark, tmp_path):
    rows = [(i, at(i), u, "a", 1.0 + i) for i, u in enumerate([0, 1, 2, 2, 9, 9])]
    s = feed(spark, tmp_path / "in", rows, 3).stream()
    got = {(x.user_id, x.n, x.total) for x in streams.drain(streams.user_totals(s), "update", ["user_id"]).collect()}
    assert got == {(0, 1, 1.0), (1, 1, 2.0), (2, 2, 7.0), (9, 2, 11.0)}


def test_every_stream_over_several_batches(spark, tmp_path):
    rows = events(random.Random(1), 300)
    f = feed(spark, tmp_path / "in", rows, 5)
    df = spark.createDataFrame(rows, EVENTS)
    flat = lambda d: sorted(map(tuple, streams.flat_window(d).collect()))
    assert flat(streams.drain(streams.tumbling(f.stream().withWatermark("ts", "1 hour"), "1 day"), "complete")) == flat(streams.tumbling(df, "1 day"))
    twice = f.stream().union(f.stream())
    assert sorted(x.id for x in streams.drain(streams.deduplicated(twice, ["id"], "9 days").select("id")).collect()) == list(range(300))
    assert streams.drain(f.stream().select("id")).count() == 300


@pytest.mark.parametrize("batches", [1, 4])
def test_throttle_and_cache_equal_plain_loops(spark, tmp_path, batches):
    rows = events(random.Random(2), 250)
    f = feed(spark, tmp_path / "in", rows, batches)
    last, ran, stored, hit = {}, set(), {}, {}
    for i, ts, u, s, _ in rows:
        if u not in last or ts - last[u][0] >= datetime.timedelta(hours=12) and s != last[u][1]:
            last[u] = ts, s
            ran.add(i)
        hit[i] = u in stored and ts - stored[u] <= datetime.timedelta(hours=1)
        if not hit[i]:
            stored[u] = ts
    assert {x.id for x in streams.drain(stateful.runs(f.stream(), "user_id", 12, "event_type")).collect()} == ran
    assert {x.id: x.hit for x in streams.drain(stateful.hits(f.stream(), "user_id", 3600, "1 hour")).collect()} == hit


def test_cache_state_goes_when_it_is_too_old(spark, tmp_path):
    f = Feed(spark, tmp_path / "in", EVENTS).add([(1, at(0), 1, "a", 0.0)]).add([(2, at(600), 2, "a", 0.0)]).add([(3, at(601), 2, "a", 0.0)])
    to = f"file://{tmp_path}/out"
    streams.drain(stateful.hits(f.stream(), "user_id", 3600, "1 minute"), to=to)
    assert {x.user_id for x in stateful.state_of(spark, to + "-state").select("user_id").collect()} == {2}


def test_reminders_fire_by_timer_once_over_restarts(spark, tmp_path):
    """User 1's reminders fire though only user 2's rows move the time; each once, and no state is left behind."""
    schema = "id long, ts timestamp, user_id long, due timestamp"
    f = Feed(spark, tmp_path / "in", schema).add([(1, at(0), 1, at(30)), (2, at(0), 1, at(90)), (3, at(0), 2, at(5))])
    to = f"file://{tmp_path}/out"

    def run():
        return sorted((x.user_id, x.id) for x in streams.drain(stateful.reminders(f.stream(), "user_id", "0 minutes"), to=to).collect())

    waits = lambda: sorted(x.user_id for x in stateful.state_of(spark, to + "-state").collect())
    assert run() == [] and waits() == [1, 2]
    f.add([(4, at(40), 3, at(41))])
    assert run() == [(1, 1), (2, 3)] and waits() == [1, 3]
    f.add([(5, at(95), 3, at(500))])
    assert run() == [(1, 1), (1, 2), (2, 3), (3, 4)] and waits() == [3]
    assert run() == [(1, 1), (1, 2), (2, 3), (3, 4)]


def plain_steps(rows):
    status, kept, done = {}, {}, []
    for i, _, task, kind in rows:
        queue = kept.setdefault(task, [])
        if kind == "grant":
            if status.get(task) == "wait":
                status[task] = "run"
                while queue and status[task] == "run":
                    j, k = queue.pop(0)
                    if k == "ask":
                        status[task] = "wait"
                    else:
                        done.append((task, j))
        elif status.get(task) == "wait":
            queue.append((i, kind))
        elif kind == "ask":
            status[task] = "wait"
        else:
            done.append((task, i))
    return done, {t: [i for i, _ in kept[t]] for t, s in status.items() if s == "wait"}


def test_tasks_pause_and_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, at(i), r.randrange(3), r.choice(["step", "step", "step", "ask", "grant"])) for i in range(120)]
    f = Feed(spark, tmp_path / "in", "id long, ts timestamp, task long, kind string")
    to = f"file://{tmp_path}/out"
    for i in range(0, 120, 30):
        f.add(rows[i : i + 30])
        got = streams.drain(stateful.steps(f.stream(), "task"), to=to).collect()  # a new query each time, as after a crash
        done, waiting = plain_steps(rows[: i + 30])
        assert sorted((x.task, x.id) for x in got) == sorted(done)
        assert {x.task: list(x.ids) for x in stateful.waiting_tasks(spark, to + "-state", "task").collect()} == waiting
    assert done and waiting


def test_a_batch_that_fails_is_run_again_without_loss(spark, tmp_path):
    """The sink dies in the second batch; the next run repeats it from the same state."""
    f = Feed(spark, tmp_path / "in", "id long, ts timestamp, task long, kind string").add([(1, at(1), 1, "step"), (2, at(2), 1, "ask"), (3, at(3), 1, "step")]).add([(4, at(4), 1, "grant"), (5, at(5), 1, "step")])
    to, seen = f"file://{tmp_path}/out", []

    def sink(fail):
        def batch(df, n):
            if fail and n == 1:
                raise RuntimeError("killed")
            df.write.mode("overwrite").parquet(f"{to}/batch={n}")
            seen.append(n)

        return batch

    def start(fail):
        return stateful.steps(f.stream(), "task").writeStream.option("checkpointLocation", to + "-state").trigger(availableNow=True).foreachBatch(sink(fail)).start()

    with pytest.raises(Exception):  # noqa: B017
        start(True).awaitTermination()
    start(False).awaitTermination()
    assert seen == [0, 1] and sorted(x.id for x in spark.read.parquet(to).collect()) == [1, 3, 5]


def test_a_side_table_is_read_again_by_age(spark, tmp_path):
    side, now = f"file://{tmp_path}/side", [0.0]
    put = lambda v, name: spark.createDataFrame([(0, name), (1, name)], "user_id long, name string").write.parquet(f"{side}/{v}")
    put("v1", "old")
    f = Feed(spark, tmp_path / "in", EVENTS).add([(1, at(0), 0, "a", 0.0)]).add([(2, at(1), 1, "a", 0.0)]).add([(3, at(2), 5, "a", 0.0)])
    calls = []

    def clock():
        calls.append(1)
        now[0] += 15  # batches at 15, 30 and 45 seconds
        if len(calls) == 2:
            put("v2", "new")
        return now[0]

    got = {x.id: (x.name, x.side_version) for x in stateful.enriched(f.stream(), side, "user_id", 20.0, f"file://{tmp_path}/out", clock).collect()}
    assert got == {1: ("old", "v1"), 2: ("old", "v1"), 3: (None, "v2")}
