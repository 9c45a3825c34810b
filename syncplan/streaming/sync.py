"""Continuous runs: T1 to T6, T10 and T11."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.diff import DELTAS, SnapshotState
from ..operators.ignore import filter_ignored
from ..operators.watchers import Watcher, assign_watcher
from ..schemas import CREATE, DELETE, ENTRY, UPDATE
from ..scratch import shared_dir
from ..sources.store import BucketStore

#: Buckets of the items that wait in ``retry_stream``.
RETRY_BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scan_once(
    spark: SparkSession,
    list_entries: Callable[[str], DataFrame],
    watcher: Watcher,
    watchers: Iterable[Watcher],
    state_path: str,
    connector: str,
    observed: datetime.datetime,
    handle: Callable[[DataFrame], None],
    ignore: Iterable[str] = (),
) -> int:
    """Lists what the watcher owns, hands its changes over, and then makes them its new state.

    The changes are written before they are handled, and those that were written are committed, so a listing that goes on
    changing can't lose any between the two.  They are committed last: if ``handle`` fails they come again.
    """
    scope = connector if not watcher.prefix else f"{connector}#{watcher.prefix}"
    listing = filter_ignored(list_entries(watcher.prefix), ignore)
    own = assign_watcher(listing, watchers).filter(F.col("watcher") == watcher.prefix).drop("watcher")
    return hand_over(SnapshotState(spark, state_path, scope, ENTRY), own, connector, observed, handle)


def hand_over(state: SnapshotState, listing: DataFrame, connector: str, observed: datetime.datetime, handle: Callable[[DataFrame], None], note: str | None = None) -> int:
    """Writes what a listing changes, hands it over as events, and makes it the scope's next generation."""
    pieces, changed = state.stage(listing)
    kind = F.when(F.col("_deleted"), DELETE).when(F.col("_was"), UPDATE).otherwise(CREATE)
    change = F.when(F.col("_deleted"), "deleted").when(F.col("_was"), "modified").otherwise("new")
    try:
        handle(changed.select("path", "size", "mtime", "hash", "metadata", change.alias("change"), kind.alias("kind"), F.lit(observed).alias("observed"), F.lit(connector).alias("connector")))
    except Exception:
        state.store.discard(pieces)
        raise
    return state.commit(pieces, note)


def watch(spark: SparkSession, watcher: Watcher, scan: Callable[[datetime.datetime], None], checkpoint: str) -> StreamingQuery:
    """Scans at once and then at the watcher's interval; one query for each watcher, each with its own state.

    A scan that fails doesn't stop the query: its changes come with the next scan, as its state wasn't committed.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            scan(datetime.datetime.now(datetime.timezone.utc))
        except Exception as e:  # noqa: BLE001
            print(f"scan {batch_id} of watcher {watcher.prefix!r} failed: {e}")

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{watcher.poll_seconds} seconds").start()


class _Differ(StatefulProcessor):
    """Last (size, mtime, hash) of a path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "size long, mtime timestamp, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feed = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in feed.itertuples(index=False):
            now = (int(r.size), r.mtime.to_pydatetime() if hasattr(r.mtime, "to_pydatetime") else r.mtime, r.hash or "")
            kind = None
            if r.deleted:
                kind, last = (DELETE, None) if last is not None else (None, None)
            elif last is None:
                kind, last = CREATE, now
            elif tuple(last) != now:
                kind, last = UPDATE, now
            if kind:
                out.append((*key, int(r.seq), kind))
        if last is None:
            self.last.clear()
        else:
            self.last.update(tuple(last))
        yield pd.DataFrame(out, columns=["scope", "path", "seq", "kind"])

    def close(self) -> None:
        pass


def diff_stream(feed: DataFrame) -> DataFrame:
    """Changes ``scope, path, seq, kind`` of a feed of listing rows (scope, path, seq, size, mtime, hash, deleted).

    State is the last row of each path, in the state store; the session needs ``use_state_store``.
    """
    return feed.groupBy("scope", "path").transformWithStateInPandas(
        statefulProcessor=_Differ(), outputStructType="scope string, path string, seq long, kind string", outputMode="Append", timeMode="None"
    )


class _Pairing(StatefulProcessor):
    """Companions of one channel, directory and stem that wait for their asset, for a lifetime if one is given."""

    def __init__(self, lifetime_ms: int | None = None):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asset = handle.getValueState("asset", "path string")
        self.waiting = handle.getMapState("waiting", "path string", "seq long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feed = pd.concat(list(rows)).sort_values("seq")
        out = []
        for r in feed.itertuples(index=False):
            known = self.asset.get()[0] if self.asset.exists() else None
            if r.companion:
                if known is not None:
                    out.append((*key, int(r.seq), known, r.path, "deleted" if r.deleted else "patch"))
                elif r.deleted:
                    if self.waiting.containsKey((r.path,)):
                        self.waiting.removeKey((r.path,))
                else:
                    until = -1 if self.lifetime_ms is None else int(r.at.timestamp() * 1000) + self.lifetime_ms
                    self.waiting.updateValue((r.path,), (int(r.seq), until))
                    if until >= 0:
                        self.handle.registerTimer(until)
            elif not r.deleted:
                if known is None:
                    folded = sorted(k[0] for k in self.waiting.keys())
                    out.append((*key, int(r.seq), r.path, None, "create"))
                    out += [(*key, int(r.seq), r.path, p, "fold") for p in folded]
                    self.waiting.clear()
                    self.asset.update((r.path,))
                else:
                    out.append((*key, int(r.seq), r.path, None, "update"))
        yield pd.DataFrame(out, columns=_PAIRED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted((path[0], value[0]) for path, value in self.waiting.iterator() if 0 <= value[1] <= now)
        for path, _ in gone:
            self.waiting.removeKey((path,))
        yield pd.DataFrame([(*key, int(seq), None, path, "expired") for path, seq in gone], columns=_PAIRED)

    def close(self) -> None:
        pass


_PAIRED = ["channel_name", "dir", "stem", "seq", "path", "companion_path", "action"]


def companion_stream(feed: DataFrame, lifetime: datetime.timedelta | None = None) -> DataFrame:
    """Actions for assets and companions as they come (channel_name, dir, stem, seq, path, companion, deleted).

    A companion before its asset is folded into the create; one after it is a patch; a deleted one is told to its
    function; a deleted asset's record stays.  With a ``lifetime``, a companion that has waited so long is an action
    ``expired`` with no asset, and state holds none of it any more; the feed then has a timestamp ``at`` with a watermark,
    which says how late it is.
    """
    schema = "channel_name string, dir string, stem string, seq long, path string, companion_path string, action string"
    of = feed.groupBy("channel_name", "dir", "stem")
    if lifetime is None:
        return of.transformWithStateInPandas(statefulProcessor=_Pairing(), outputStructType=schema, outputMode="Append", timeMode="None")
    ms = int(lifetime.total_seconds() * 1000)
    return of.transformWithStateInPandas(statefulProcessor=_Pairing(ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Retrying(StatefulProcessor):
    """Items of work of one bucket, packed: attempts and due time of each, and one timer for the next that is to run."""

    def __init__(self, max_attempts: int, base: float, most: float):
        self.max_attempts, self.base, self.most = max_attempts, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("items", "items binary, timer_ms long")

    def _load(self) -> tuple[dict[int, tuple[int, int, bool]], int]:
        """Attempts, due time and whether it waits for it of each item, and the timer that is set (-1: none)."""
        if (kept := self.state.get()) is None:
            return {}, -1
        rows = np.frombuffer(kept[0], _ITEM)
        return dict(zip(rows["id"].tolist(), zip(rows["attempts"].tolist(), rows["next_us"].tolist(), rows["waits"].tolist(), strict=True), strict=True)), kept[1]

    def _keep(self, items: dict[int, tuple[int, int, bool]], timer: int) -> None:
        """Writes the items back and sets the timer to the first that waits."""
        rows = np.fromiter(((i, *item) for i, item in items.items()), _ITEM, len(items))
        waiting = rows["next_us"][rows["waits"]]
        first = int(-(-waiting.min() // 1000)) if len(waiting) else -1
        if first != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if first >= 0:
                self.handle.registerTimer(first)
        if items:
            self.state.update((rows.tobytes(), first))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (items, timer), out = self._load(), []
        frames = list(rows)
        feed = (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values("at_us", kind="stable")
        columns = (feed[c].tolist() for c in ("id", "at_us", "status", "attempts", "next_us", "ok", "error"))
        for id, at_us, status, attempts, next_us, ok, error in zip(*columns, strict=True):
            if status is not None:
                items[id] = (attempts, next_us, status == "pending" and next_us >= 0)
            elif ok is not None and id in items:
                attempts, next_us, _ = items.pop(id)
                if ok:
                    out.append((id, "done", attempts, next_us, None))
                    continue
                attempts += 1
                if attempts >= self.max_attempts:
                    items[id] = (attempts, next_us, False)
                    out.append((id, "failed", attempts, next_us, error))
                else:
                    next_us = at_us + int(min(self.most, self.base * 2.0 ** (attempts - 1)) * 1_000_000)
                    items[id] = (attempts, next_us, next_us >= 0)
                    out.append((id, "pending", attempts, next_us, error))
        self._keep(items, timer)
        if out:
            yield pd.DataFrame(out, columns=_RETRIED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (items, timer), out = self._load(), []
        fired, clock = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if fired == timer:
            for id, (attempts, next_us, waits) in items.items():
                if waits and ((at := -(-next_us // 1000)) < clock or at <= fired):
                    out.append((id, "due", attempts, next_us, None))
            items |= {id: (attempts, next_us, False) for id, _, attempts, next_us, _ in out}
            self._keep(items, -1)  # the timer that expired goes by itself
        if out:
            yield pd.DataFrame(out, columns=_RETRIED)

    def close(self) -> None:
        pass


_ITEM = np.dtype([("id", "<i8"), ("attempts", "<i4"), ("next_us", "<i8"), ("waits", "?")])
_RETRIED = ["id", "event", "attempts", "next_us", "error"]
#: Of an item without a time.
_NEVER = -(1 << 63)


def retry_stream(feed: DataFrame, max_attempts: int = 5, base: float = 2.0, most: float = 300.0, buckets: int = RETRY_BUCKETS) -> DataFrame:
    """Events ``id, event, attempts, next_run_at, error`` of items of work: ``due`` when one is to run, by itself, and what
    became of it: ``done``, ``pending`` again after its back-off, or ``failed`` for good.

    ``feed`` has id, ``at`` (a timestamp with a watermark, whose progress is the clock) and either an item to queue (status,
    attempts, next_run_at) or an item's outcome (ok, error).  A failed item becomes due at ``next_run_at``; state holds
    21 bytes for each item that isn't done.  Items lie in ``buckets`` by a hash of their id: a bucket is a value of the state
    store with a timer for its next item, so a micro-batch reads and writes the buckets of its ids whole.  The number can't
    change between runs from one checkpoint.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    rows = feed.select(bucket.alias("_bucket"), "id", "at", F.unix_micros("at").alias("at_us"), "status", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce(F.unix_micros("next_run_at"), F.lit(_NEVER)).alias("next_us"), "ok", "error")
    made = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_Retrying(max_attempts, base, most),
        outputStructType="id long, event string, attempts int, next_us long, error string",
        outputMode="Append",
        timeMode="EventTime",
    )
    due = F.when(F.col("next_us") != _NEVER, F.timestamp_micros("next_us"))
    return made.select("id", "event", "attempts", due.alias("next_run_at"), "error")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def with_plan_id(plan: DataFrame) -> DataFrame:
    """The same channel, path and version always have the same id."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("channel_name", "path", "hash")]
    return plan.withColumn("plan_id", F.sha2(F.concat_ws("\x00", *parts), 256))


def write_once(spark: SparkSession, plan: DataFrame, path: str, batch_id: int = 0) -> int:
    """Appends plans that are not there yet, and returns the version that has them; a repeated batch adds nothing.

    Plans lie in buckets of their ids, and only the buckets of the batch's ids are read.  A batch is seen whole or not at
    all, so one that failed half-way leaves nothing.
    """
    store, rows = BucketStore(spark, path, {"plans": "plan_id"}), with_plan_id(plan)
    met = store.touched(rows, "plan_id")
    done = store.read("plans", "plan_id string", met)
    new = store.stage("plans", rows.dropDuplicates(["plan_id"]).join(done, "plan_id", "left_anti"))
    version = store.commit(new, note=str(batch_id))
    store.compact("plans", _ddl(rows), DELTAS, lambda merged, whole: merged)
    return version


def written_plans(spark: SparkSession, path: str, schema: str, of: DataFrame | None = None) -> DataFrame:
    """Plans that ``write_once`` has written; of those of the rows ``of`` (with plan_id) only their buckets are read."""
    store = BucketStore(spark, path, {"plans": "plan_id"})
    return store.read("plans", schema, None if of is None else store.touched(of, "plan_id"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: what fails, fails now."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Refreshing:
    """A table that is read anew each time; if the read fails, in planning or while it runs, what was read last stays."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read, self.last = read, None

    def get(self) -> DataFrame:
        try:
            self.last = _written(self.read())
        except Exception:  # noqa: BLE001
            if self.last is None:
                raise
        return self.last


def isolated(parts: dict[str, Callable[[], DataFrame]], at_once: int = 8) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results by name, and errors by name: one channel's failure, in planning or while it runs, doesn't touch the others.

    So many channels run beside one another, and a slow one keeps none of the others waiting.
    """
    out, errors = {}, {}
    with ThreadPoolExecutor(at_once) as pool:
        begun = {name: pool.submit(inheritable_thread_target(lambda make=make: _written(make()))) for name, make in parts.items()}
    for name, result in begun.items():
        if (e := result.exception()) is None:
            out[name] = result.result()
        elif isinstance(e, Exception):
            errors[name] = f"{type(e).__name__}: {e}"
        else:
            raise e
    return out, errors
