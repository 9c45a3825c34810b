"""Tables in hash buckets of a key, changed bucket by bucket behind one pointer: what K1, K5, K9 and T6 write to.

A table is Parquet in folders, one for each bucket of each write ("piece").  A small JSON file, the pointer, names the pieces
of every bucket for the last versions; it is replaced as a whole after all pieces are written, so readers see a version or
the one before it, and what a failed write left is seen by nobody.  A change touches only the buckets of its keys; pieces
that no kept version names are deleted.  A store has one writer at a time; a commit from a version that isn't the last fails.

The pointer holds a name for each bucket and piece, so its size is bounded by ``buckets`` and the pieces between compactions,
not by rows.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a bucket's changes from which on they may be merged with its base before there are many.
GROWN = 256 << 10


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it over the old one, so readers find either, whole."""
    at, fs = _fs(spark, path)
    fs.mkdirs(at.getParent())
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(made)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    names = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    names.rename(fs.makeQualified(made), fs.makeQualified(at), over)


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    at, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs now go when it ends; else they stay until the driver collects its garbage."""
    had = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if had is None else spark.conf.set(CLEANUP, had)


@dataclass(frozen=True)
class Pieces:
    """A write that nobody sees yet: its folder, the buckets that it has rows of, and those that it stands for as a whole."""

    table: str
    name: str
    made: tuple[int, ...]
    replaces: tuple[int, ...] = ()


class BucketStore:
    """Tables at ``path``, each with the column that deals its rows to buckets (a null key is dealt as an empty one)."""

    #: Bytes of pieces that are merged or compared at once, so that shuffle files are those of a part.
    part_bytes = 256 << 20

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, max(1, keep)
        self.kept = json.loads(read_text(spark, f"{self.path}/pointer.json") or '{"versions": []}')
        self.buckets = self.kept.setdefault("buckets", buckets)

    @property
    def version(self) -> int:
        """The last version; 0 before the first."""
        return self.kept["versions"][-1]["version"] if self.kept["versions"] else 0

    def pieces(self, table: str, version: int | None = None) -> dict[int, list[str]]:
        """Pieces of each bucket, as they were written.  A version that isn't kept any more is an error."""
        version = self.version if version is None else version
        if version == 0:
            return {}
        for v in self.kept["versions"]:
            if v["version"] == version:
                return {int(b): names for b, names in v["tables"].get(table, {}).items()}
        have = [v["version"] for v in self.kept["versions"]]
        raise ValueError(f"version {version} of {self.path} isn't kept; there are {have}")

    def bucket(self, key: Column | str) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets of the rows' keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def read(self, table: str, schema: str, only: Iterable[int] | None = None, version: int | None = None, part: slice = slice(None)) -> DataFrame:
        """Rows of the table, of buckets ``only`` if given; ``part`` takes some of each bucket's pieces, in order of writing."""
        have = self.pieces(table, version)
        wanted = sorted(have) if only is None else sorted(set(only) & set(have))
        paths = [f"{self.path}/{table}/{name}/_bucket={b}" for b in wanted for name in have[b][part]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def size(self, table: str) -> int:
        """Bytes of the table's pieces, of all kept versions."""
        return self._size(f"{self.path}/{table}") if self.version else 0

    def stage(self, table: str, rows: DataFrame, replaces: Iterable[int] = (), into: Pieces | None = None) -> Pieces:
        """Writes the rows to a new piece of each of their buckets; in place of all pieces of the buckets ``replaces``.

        With ``into``, an earlier write that nobody sees yet gets rows of further buckets.
        """
        name = into.name if into else uuid.uuid4().hex
        where = f"{self.path}/{table}/{name}"
        dealt = rows.withColumn("_bucket", self.bucket(self.keys[table])).repartition("_bucket")
        with no_shuffles_left(self.spark):
            dealt.write.mode("append" if into else "errorifexists").partitionBy("_bucket").option("compression", "zstd").parquet(where)
        made = sorted(int(f.split("=")[1]) for f in folders(self.spark, where) if f.startswith("_bucket="))
        return Pieces(table, name, tuple(made), tuple(sorted(replaces)))

    def staged(self, pieces: Pieces, schema: str) -> DataFrame:
        """The rows of a write, before or after its commit."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{pieces.table}/{pieces.name}").drop("_bucket")

    def discard(self, pieces: Pieces) -> None:
        delete_folder(self.spark, f"{self.path}/{pieces.table}/{pieces.name}")

    def commit(self, *writes: Pieces, note: str | None = None) -> int:
        """Makes the writes the next version, all at once; ``note`` is kept with it."""
        tables = {t: dict(own) for t, own in self.kept["versions"][-1]["tables"].items()} if self.kept["versions"] else {}
        for w in writes:
            own = tables.setdefault(w.table, {})
            for b in w.replaces:
                own.pop(str(b), None)
            for b in w.made:
                own[str(b)] = [*own.get(str(b), []), w.name]
        version = {"version": self.version + 1, "tables": tables, "note": note}
        self._point([*self.kept["versions"], version][-self.keep :])
        return self.version

    def note(self) -> str | None:
        return self.kept["versions"][-1]["note"] if self.kept["versions"] else None

    def compact(self, table: str, schema: str, most: int, merge: Callable[[DataFrame, bool], DataFrame], grown: int | None = None) -> list[int]:
        """Merges the newest pieces of each bucket that has more than ``most``, and returns those buckets.

        With ``grown``, a bucket whose newer pieces have so many bytes, and three quarters of its oldest's, is merged as a whole too:
        a table of changes then costs less than three times its rows, and reading it little more than reading its base.

        An older piece is merged too as long as it is less than four times as large as all newer ones, so a large base is
        rewritten only when its changes have grown with it.  ``merge`` gets the rows and whether they are all of their
        buckets.  The last version stays the same in what it holds.
        """
        have = self.pieces(table)
        begin = {b: self._newest(table, b, names) for b, names in have.items() if len(names) > most}
        if grown is not None:
            begin |= {b: 0 for b, names in have.items() if len(names) > 1 and self._grown(table, b, names, grown)}
        version = json.loads(json.dumps(self.kept["versions"][-1])) if begin else {}
        for whole in (True, False):
            own = {b: at for b, at in begin.items() if (at == 0) == whole}
            for part in self._parts(table, {b: have[b][at:] for b, at in own.items()}):
                paths = [f"{self.path}/{table}/{name}/_bucket={b}" for b, names in part.items() for name in names]
                made = self.stage(table, merge(self.spark.read.schema(schema).parquet(*paths), whole))
                for b, at in ((b, own[b]) for b in part):
                    names = [*have[b][:at], *([made.name] if b in made.made else [])]
                    version["tables"][table].pop(str(b))
                    if names:
                        version["tables"][table][str(b)] = names
        if begin:
            self._point([*self.kept["versions"][:-1], version])
        return sorted(begin)

    def _parts(self, table: str, pieces: dict[int, list[str]]) -> Iterator[dict[int, list[str]]]:
        """Buckets of ``part_bytes`` together, or one that is larger."""
        part, total = {}, 0
        for b, names in pieces.items():
            size = sum(self._size(f"{self.path}/{table}/{name}/_bucket={b}") for name in names)
            if part and total + size > self.part_bytes:
                yield part
                part, total = {}, 0
            part[b], total = names, total + size
        if part:
            yield part

    def _newest(self, table: str, bucket: int, names: list[str]) -> int:
        """Where the pieces begin that are merged."""
        at, total = len(names), 0
        while at:
            size = self._size(f"{self.path}/{table}/{names[at - 1]}/_bucket={bucket}")
            if len(names) - at >= 2 and size >= 4 * total:
                break
            at, total = at - 1, total + size
        return at

    def _grown(self, table: str, bucket: int, names: list[str], least: int) -> bool:
        base, *newer = (self._size(f"{self.path}/{table}/{name}/_bucket={bucket}") for name in names)
        return sum(newer) >= max(least, 3 * base // 4)

    def _size(self, path: str) -> int:
        at, fs = _fs(self.spark, path)
        return fs.getContentSummary(at).getLength()

    def _point(self, versions: list[dict]) -> None:
        """Replaces the pointer and deletes what it names no longer."""
        there = json.loads(read_text(self.spark, f"{self.path}/pointer.json") or '{"versions": []}')
        if there["versions"] != self.kept["versions"]:
            raise RuntimeError(f"{self.path} was changed by another writer since it was read")
        old, kept = self._named(self.kept["versions"]), {**self.kept, "versions": versions}
        replace_text(self.spark, f"{self.path}/pointer.json", json.dumps(kept))
        self.kept = kept
        gone, still = old - self._named(versions), {(t, name) for t, name, _ in self._named(versions)}
        for table, name in {(t, name) for t, name, _ in gone}:
            if (table, name) in still:
                for b in (b for t, n, b in gone if (t, n) == (table, name)):
                    delete_folder(self.spark, f"{self.path}/{table}/{name}/_bucket={b}")
            else:
                delete_folder(self.spark, f"{self.path}/{table}/{name}")

    @staticmethod
    def _named(versions: list[dict]) -> set[tuple[str, str, str]]:
        return {(t, name, b) for v in versions for t, own in v["tables"].items() for b, names in own.items() for name in names}
