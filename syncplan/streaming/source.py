"""Listings as a streaming source: T1 and T2 by Spark's own Python data source interface.

``readStream.format("listing")`` gives rows (watcher, scan, path, size, mtime, hash).  Offsets are scans by watcher, and a
micro-batch has a partition for each watcher and scan that came since the last, so watchers are listed by tasks beside one
another and each at its own interval.  Each partition begins with a row without a path, so that a scan that finds nothing is
seen too.

Options: ``root``; ``watchers``, a JSON list of [prefix, seconds]; ``kind``: ``tree`` lists the folder ``root`` as it is, and
scans are numbered by the clock, so numbers go on after a restart; ``inventories`` reads listings that were delivered as
Parquet in folders ``root``/scan=0, scan=1 and so on, each with a file ``_SUCCESS`` once it is whole, every one of them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import SnapshotState
from ..operators.ignore import filter_ignored
from ..operators.watchers import Watcher
from ..schemas import ENTRY
from ..sources.listing import _children, _open_store
from .sync import hand_over

_ROW = pa.schema([("watcher", pa.string()), ("scan", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("hash", pa.string())])


@dataclass
class _Scan(InputPartition):
    watcher: str
    scan: int
    below: tuple[str, ...]  # prefixes of other watchers within this one's


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["root"], options.get("kind", "tree")
        if self.kind not in ("tree", "inventories"):
            raise ValueError(f"kind is 'tree' or 'inventories', not {self.kind!r}")
        self.watchers = [(str(p), float(s)) for p, s in json.loads(options["watchers"])]

    def initialOffset(self) -> dict:
        now = time.time()
        return {p: int(now / s) - 1 if self.kind == "tree" else -1 for p, s in self.watchers}

    def latestOffset(self) -> dict:
        if self.kind == "tree":
            return {p: int(time.time() / s) for p, s in self.watchers}
        store, base = _open_store(self.root)
        number = -1
        while _whole(store, f"{base}/scan={number + 1}"):
            number += 1
        return {p: number for p, _ in self.watchers}

    def partitions(self, start: dict, end: dict) -> list[_Scan]:
        out = []
        for p, _ in self.watchers:
            below = tuple(x for x, _ in self.watchers if x != p and (not p or x.startswith(f"{p}/")))
            first = end[p] if self.kind == "tree" else start.get(p, -1) + 1  # of a tree only the last scan can be made
            out += [_Scan(p, n, below) for n in range(first, end[p] + 1) if n > start.get(p, -1)]
        return out

    def read(self, part: _Scan) -> Iterator[pa.RecordBatch]:
        yield _rows(part, pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], _ROW.field("mtime").type), pa.array([None], pa.string()))
        yield from self._tree(part) if self.kind == "tree" else self._inventory(part)

    def _tree(self, part: _Scan) -> Iterator[pa.RecordBatch]:
        store, base = _open_store(self.root)
        waiting, found = [part.watcher], []

        def out() -> pa.RecordBatch:
            paths, sizes, changed = zip(*found, strict=True)
            tokens = [f"{s}-{c}" for s, c in zip(sizes, changed, strict=True)]
            found.clear()
            return _rows(part, pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(changed, _ROW.field("mtime").type), pa.array(tokens, pa.string()))

        while waiting:
            folder = waiting.pop()
            for name, is_folder, size, changed in _children(store, f"{base}/{folder}".rstrip("/")):
                path = f"{folder}/{name}" if folder else name
                if not is_folder:
                    found.append((path, size, changed // 1000))
                elif path not in part.below:
                    waiting.append(path)
                if len(found) >= 10_000:
                    yield out()
        if found:
            yield out()

    def _inventory(self, part: _Scan) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, base = _open_store(self.root)
        path = ds.field("path")
        under = lambda p: pc.starts_with(path, f"{p}/") | (path == p)
        wanted = under(part.watcher) if part.watcher else path.is_valid()
        for p in part.below:
            wanted = wanted & ~under(p)
        for batch in ds.dataset(f"{base}/scan={part.scan}", format="parquet", filesystem=store).to_batches(columns=["path", "size", "mtime", "hash"], filter=wanted):
            if batch.num_rows:
                yield _rows(part, batch.column(0), batch.column(1), batch.column(2).cast(_ROW.field("mtime").type), batch.column(3))


def _whole(store, folder: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(f"{folder}/_SUCCESS").type == fs.FileType.File


def _rows(part: _Scan, path: pa.Array, size: pa.Array, mtime: pa.Array, token: pa.Array) -> pa.RecordBatch:
    n = len(path)
    return pa.RecordBatch.from_arrays([pa.array([part.watcher] * n, pa.string()), pa.array([part.scan] * n, pa.int64()), path, size, mtime, token], schema=_ROW)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "watcher string, scan long, path string, size long, mtime timestamp, hash string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def listing_stream(spark: SparkSession, root: str, watchers: Iterable[Watcher], kind: str = "tree") -> DataFrame:
    """The source's rows; ``watchers`` are normalized ones."""
    spark.dataSource.register(ListingSource)
    given = json.dumps([[w.prefix, w.poll_seconds] for w in watchers])
    return spark.readStream.format("listing").options(root=root, watchers=given, kind=kind).load()


def sync_listings(
    listings: DataFrame,
    state_path: str,
    connector: str,
    handle: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    ignore: Iterable[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hands over what each scan changed, ``handle(changes, watcher, scan)``, and commits it; see ``scan_once``.

    A scan that was committed before a restart isn't handled again.
    """
    ignore = list(ignore)

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            scans = sorted((r["scan"], r["watcher"], r["at"]) for r in batch.filter("path is null").select("scan", "watcher", F.current_timestamp().alias("at")).collect())
            for scan, watcher, at in scans:
                state = SnapshotState(spark, state_path, connector if not watcher else f"{connector}#{watcher}", ENTRY)
                if state.store.note() is not None and int(state.store.note()) >= scan:
                    continue
                own = batch.filter((F.col("scan") == scan) & (F.col("watcher") == watcher) & F.col("path").isNotNull())
                own = own.select("path", "size", "mtime", "hash", F.lit(None).cast("map<string,string>").alias("metadata"))
                hand_over(state, filter_ignored(own, ignore), connector, at, lambda rows, w=watcher, n=scan: handle(rows, w, n), note=str(scan))
        finally:
            batch.unpersist()

    return listings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()

