import datetime
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from syncplan.operators.diff import load_snapshot
from syncplan.operators.watchers import Watcher, normalize_watchers
from syncplan.schemas import ENTRY
from syncplan.sources.store import BucketStore
from syncplan.streaming.source import listing_stream, sync_listings
from syncplan.streaming.sync import Refreshing, companion_stream, diff_stream, isolated, retry_stream, scan_once, use_state_store, watch, with_plan_id, write_once, written_plans

T0 = datetime.datetime(2024, 1, 1)
FEED = "scope string, path string, seq long, size long, mtime timestamp, hash string, deleted boolean"


def _run(spark, tmp_path, make, batches, schema, name):
    """Batches as files, one micro-batch each; all rows that came out."""
    use_state_store(spark)
    source = tmp_path / "feed"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = make(spark.readStream.schema(schema).parquet(str(source)))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_keyed_diff(spark, tmp_path):
    a = [("s", "a", 1, 1, T0, "h", False), ("s", "a", 2, 1, T0, "h", False), ("s", "b", 3, 1, T0, "h", False)]
    b = [("s", "a", 4, 2, T0, "h", False), ("s", "b", 5, None, None, None, True), ("s", "b", 6, None, None, None, True), ("s", "b", 7, 1, T0, "h", False)]
    rows = _run(spark, tmp_path, diff_stream, [a, [(*x[:3], x[3] or 0, x[4] or T0, x[5] or "", x[6]) for x in b]], FEED, "d")
    assert sorted((r["seq"], r["path"], r["kind"]) for r in rows) == [(1, "a", "OnCreate"), (3, "b", "OnCreate"), (4, "a", "OnUpdate"), (5, "b", "OnDelete"), (7, "b", "OnCreate")]


def test_companions_wait_for_assets(spark, tmp_path):
    schema = "channel_name string, dir string, stem string, seq long, path string, companion boolean, deleted boolean"
    a = [("c", "d", "s", 1, "s.xmp", True, False), ("c", "d", "s", 2, "s.txt", True, False), ("c", "d", "s", 3, "s.txt", True, True)]
    b = [("c", "d", "s", 4, "s.jpg", False, False), ("c", "d", "s", 5, "s.en.txt", True, False), ("c", "d", "s", 6, "s.xmp", True, True), ("c", "d", "s", 7, "s.jpg", False, True)]
    rows = _run(spark, tmp_path, companion_stream, [a, b], schema, "c")
    got = sorted((r["seq"], r["action"], r["companion_path"]) for r in rows if r["companion_path"]) 
    assert got == [(4, "fold", "s.xmp"), (5, "patch", "s.en.txt"), (6, "deleted", "s.xmp")]
    assert [(r["seq"], r["path"]) for r in rows if r["action"] == "create"] == [(4, "s.jpg")]


def test_companions_that_wait_too_long(spark, tmp_path):
    schema = "channel_name string, dir string, stem string, seq long, path string, companion boolean, deleted boolean, at timestamp"
    at = lambda minutes: T0 + datetime.timedelta(minutes=minutes)
    row = lambda stem, seq, path, minutes, companion=True, deleted=False: ("c", "d", stem, seq, path, companion, deleted, at(minutes))
    first = [row("s", 1, "s.xmp", 0), row("s", 2, "s.txt", 50), row("t", 3, "t.xmp", 0), row("t", 4, "t.xmp", 1, deleted=True), row("u", 5, "u.xmp", 0), row("u", 6, "u.jpg", 1, False)]
    batches = [first, [row("clock", 9, "x", 70, False, True)], [row("s", 10, "s.jpg", 71, False), row("t", 11, "t.jpg", 71, False)]]
    rows = _run(spark, tmp_path, lambda df: companion_stream(df.withWatermark("at", "0 seconds"), datetime.timedelta(hours=1)), batches, schema, "e")
    assert sorted((r["stem"], r["action"], r["companion_path"]) for r in rows if r["companion_path"]) == [("s", "expired", "s.xmp"), ("s", "fold", "s.txt"), ("u", "fold", "u.xmp")]
    assert [r["path"] for r in rows if r["action"] == "expired"] == [None]


def test_retries_by_timers(spark, tmp_path):
    schema = "id long, at timestamp, status string, attempts int, next_run_at timestamp, ok boolean, error string"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    item = lambda i, attempts, due: (i, at(0), "pending", attempts, at(due), None, None)
    outcome = lambda i, when, ok: (i, at(when), None, None, None, ok, None if ok else "boom")
    clock = lambda when: [(-1, at(when), None, None, None, None, None)]
    batches = [[item(1, 0, 5), item(2, 3, 5), item(3, 0, 500), (4, at(0), "failed", 5, at(1), None, None)], clock(10), [outcome(1, 11, False), outcome(2, 11, False), outcome(9, 11, False)], clock(12), clock(14), [outcome(1, 15, False), outcome(3, 15, True)], clock(600)]
    rows = _run(spark, tmp_path, lambda df: retry_stream(df.withWatermark("at", "0 seconds")), batches, schema, "r")
    got = {i: [(r["event"], r["attempts"], (r["next_run_at"] - T0).total_seconds()) for r in sorted(rows, key=lambda r: (r["attempts"], r["event"] == "due")) if r["id"] == i] for i in (1, 2, 3, 4, 9)}
    assert got[1] == [("due", 0, 5), ("pending", 1, 13), ("due", 1, 13), ("pending", 2, 19), ("due", 2, 19)]
    assert got[2] == [("due", 3, 5), ("pending", 4, 27), ("due", 4, 27)]
    assert got[3] == [("done", 0, 500)] and got[4] == [] and got[9] == []


def test_retries_of_many_items_in_few_buckets(spark, tmp_path):
    """Items share a bucket's value and timer: those due before the clock come at once, the rest when it is their time."""
    schema = "id long, at timestamp, status string, attempts int, next_run_at timestamp, ok boolean, error string"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    ids = range(3000)
    queued = [(i, at(0), "running" if i % 7 == 0 else "pending", i % 6, None if i % 11 == 0 else at(1 + i % 40), None, None) for i in ids]
    outcomes = [(i, at(21), None, None, None, i % 3 == 0, "boom") for i in ids if i % 3 < 2] + [(5000, at(21), None, None, None, True, None)]
    clock = lambda when: [(-1, at(when), None, None, None, None, None)]
    rows = _run(spark, tmp_path, lambda df: retry_stream(df.withWatermark("at", "0 seconds"), buckets=5), [queued, clock(20), outcomes, clock(30)], schema, "m")
    want = []
    for i in ids:
        due = None if i % 11 == 0 else 1 + i % 40
        waits = i % 7 != 0 and due is not None
        if waits and due < 20:
            want.append((i, "due", i % 6, due, None))
            waits = False
        if i % 3 == 0:
            want.append((i, "done", i % 6, due, None))
        elif i % 3 == 1 and i % 6 >= 4:
            want.append((i, "failed", i % 6 + 1, due, "boom"))
        else:
            attempts = i % 6
            if waits and due == 20:  # the clock that came with the outcomes
                waits = i % 3 == 1
                if i % 3 == 2:
                    want.append((i, "due", attempts, due, None))
            if i % 3 == 1:
                attempts, due, waits = attempts + 1, 21 + 2 ** (attempts + 1), True
                want.append((i, "pending", attempts, due, "boom"))
            if waits and due < 30:
                want.append((i, "due", attempts, due, None))
    got = [(r["id"], r["event"], r["attempts"], r["next_run_at"] and (r["next_run_at"] - T0).total_seconds(), r["error"]) for r in rows]
    assert sorted(got, key=str) == sorted(((i, e, n, None if d is None else float(d), x) for i, e, n, d, x in want), key=str)


def test_a_folder_as_a_stream_of_listings(spark, tmp_path):
    """Two watchers, one within the other's prefix: files that come, change and go, and a folder that is emptied."""
    root, seen = tmp_path / "root", []
    for name in ("a/x", "a/hot/y", "z"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("1")
    watchers = normalize_watchers([Watcher("a/hot", 0.5), Watcher("a", 1)], 1)
    handle = lambda df, watcher, scan: seen.extend((watcher, r["path"], r["kind"]) for r in df.collect())

    def scanned(done):
        query = sync_listings(listing_stream(spark, str(root), watchers), str(tmp_path / "state"), "c", handle, str(tmp_path / "cp"), ignore=["*.tmp"])
        try:
            end = time.monotonic() + 90
            while not done() and time.monotonic() < end and query.isActive:
                time.sleep(0.2)
            assert query.exception() is None
        finally:
            query.stop()

    scanned(lambda: len(seen) >= 3)
    assert sorted(seen) == [("", "z", "OnCreate"), ("a", "a/x", "OnCreate"), ("a/hot", "a/hot/y", "OnCreate")]
    (root / "a/hot/y").unlink()
    (root / "a/x").write_text("22")
    (root / "a/x.tmp").write_text("22")
    scanned(lambda: len(seen) >= 5)  # another run of the stream, from its checkpoint
    assert sorted(seen[3:]) == [("a", "a/x", "OnUpdate"), ("a/hot", "a/hot/y", "OnDelete")]


def _listing(spark, rows):
    return spark.createDataFrame([(p, 1, T0, h, None) for p, h in rows], "path string, size long, mtime timestamp, hash string, metadata map<string,string>")


def test_scan_commits_after_the_plan(spark, tmp_path):
    watchers, seen = normalize_watchers([Watcher("hot", 1)], 60), []
    args = dict(watchers=watchers, state_path=str(tmp_path), connector="c", observed=T0, ignore=["*.tmp"])
    rows = [("hot/a", "h"), ("hotel/b", "h"), ("hot/x.tmp", "h")]

    def fail(df):
        raise RuntimeError("down")

    try:
        scan_once(spark, lambda prefix: _listing(spark, rows), watchers[0], handle=fail, **args)
    except RuntimeError:
        pass
    handle = lambda df: seen.append(sorted((r["path"], r["kind"]) for r in df.collect()))
    scan_once(spark, lambda prefix: _listing(spark, rows), watchers[0], handle=handle, **args)
    scan_once(spark, lambda prefix: _listing(spark, [("hot/a", "h2")]), watchers[0], handle=handle, **args)
    scan_once(spark, lambda prefix: _listing(spark, rows), watchers[1], handle=handle, **args)
    assert seen == [[("hot/a", "OnCreate")], [("hot/a", "OnUpdate")], [("hotel/b", "OnCreate")]]


def test_watch_goes_on_after_a_failure(spark, tmp_path):
    calls = []

    def scan(now):
        calls.append(now)
        if len(calls) == 1:
            raise RuntimeError("down")

    query = watch(spark, Watcher("", 0.2), scan, str(tmp_path / "cp"))
    try:
        for _ in range(100):
            if len(calls) > 2 or query.exception():
                break
            query.awaitTermination(0.3)
    finally:
        query.stop()
    assert len(calls) > 2


def test_plans_are_written_once(spark, tmp_path):
    plan = spark.createDataFrame([("c", "a", "v1"), ("c", "a", "v1"), ("c", "b", "v1")], "channel_name string, path string, hash string")
    for batch in (0, 0, 1):
        write_once(spark, plan, str(tmp_path / "plans"), batch)
    assert written_plans(spark, str(tmp_path / "plans"), "path string").count() == 2


def test_a_batch_reads_the_buckets_of_its_ids(spark, tmp_path):
    path, schema = str(tmp_path / "plans"), "plan_id string, channel_name string, path string, hash string"
    plan = lambda *ids: spark.createDataFrame([("c", f"p{i}", "v") for i in ids], "channel_name string, path string, hash string")
    for batch in range(20):  # more pieces than a bucket may have
        write_once(spark, plan(*range(batch * 20, batch * 20 + 40)), path, batch)
    assert sorted(int(r["path"][1:]) for r in written_plans(spark, path, schema).collect()) == list(range(420))
    store = BucketStore(spark, path, {"plans": "plan_id"})
    assert max(len(p) for p in store.pieces("plans").values()) <= 13
    few = written_plans(spark, path, schema, of=with_plan_id(plan(3, 7)))
    assert 0 < few.count() < 60 and few.filter("path in ('p3', 'p7')").count() == 2
    read = few._jdf.queryExecution().executedPlan().toString()
    assert len(few.inputFiles()) < len(written_plans(spark, path, schema).inputFiles()) / 5 and "FileScan" in read


def test_a_listing_that_changes_while_it_is_handled_loses_nothing(spark, tmp_path):
    """Each evaluation of this listing gives a file more."""
    calls, seen = [], []

    def moving(prefix):
        def rows(_):
            n = len(os.listdir(tmp_path / "calls"))
            (tmp_path / "calls" / str(n)).touch()
            yield pd.DataFrame({"path": [f"f{i}" for i in range(n + 1)], "size": 1, "mtime": T0, "hash": "h", "metadata": None})

        calls.append(prefix)
        return spark.range(1, numPartitions=1).mapInPandas(rows, ENTRY)

    (tmp_path / "calls").mkdir()
    watchers = normalize_watchers([], 60)
    for _ in range(3):
        scan_once(spark, moving, watchers[0], watchers, str(tmp_path / "state"), "c", T0, lambda df: seen.extend((r["path"], r["kind"]) for r in df.collect() + df.collect()))
    assert len(calls) == 3 and set(k for _, k in seen) == {"OnCreate"}
    state = {r["path"] for r in load_snapshot(spark, str(tmp_path / "state"), "c", ENTRY).collect()}
    assert state == {p for p, _ in seen} and len(seen) == 2 * len(state)


def test_refresh_and_isolation(spark):
    reads = iter([spark.range(1), RuntimeError("down"), spark.range(3)])

    def read():
        x = next(reads)
        if isinstance(x, Exception):
            raise x
        return x

    table = Refreshing(read)
    assert [table.get().count() for _ in range(3)] == [1, 1, 3]
    good, bad = isolated({"a": lambda: spark.range(2), "b": lambda: spark.range(2).select(F.col("nope"))})
    assert list(good) == ["a"] and list(bad) == ["b"]
