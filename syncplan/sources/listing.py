"""Listings, companion contents and copy plans: S1 to S5, S7, S12, K9, O3."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_under, rel_key, trim_etag, version_token
from ..operators.companions import COMPANION_BYTES
from ..operators.ignore import filter_ignored
from ..schemas import ENTRY
from ..scratch import shared_dir
from .store import _fs

MIB = 1 << 20
BLOCK = 16 * MIB
MOST_BLOCKS = 50_000
SEGMENT = 20 * MIB
#: Bytes of contents that a task holds, about.
HELD = 32 * MIB
#: Files that a task lists below one folder.
WALKED = 20_000


def list_entries(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """ENTRY of every file below ``root``/``prefix``, paths relative to ``root``; a missing prefix gives no rows.

    Files aren't opened.  Any store that Spark reads will do; as Spark does, it leaves out empty files and names that begin
    with ``_`` or ``.``, and follows links.  A folder of a shared mount is listed by tasks, as ``walk_entries`` lists; of
    another store the driver holds Spark's own listing, read in splits of few files.
    """
    base = root.rstrip("/")
    where = f"{base}/{prefix.strip('/')}" if prefix.strip("/") else base
    at, fs = _fs(spark, where)
    if fs.getUri().getScheme() == "file" and not fs.isFile(at):
        local = f"file://{quote(_fs(spark, base)[0].toUri().getPath())}"
        found = _walk(spark, local, prefix, (), WALKED, as_spark=True).filter("size > 0")
        return _entries(found, F.timestamp_millis(F.expr("changed div 1000")))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    bare = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    bare = "/" + bare.split("/", 1)[-1] if "://" in base and not base.startswith("file:") else bare
    name = F.regexp_replace(F.col("path"), r"^[A-Za-z0-9+.-]+:(//[^/]*(?=/))?", "")
    rel = F.substring(name, len(bare) + 2, 1 << 30)
    return files.select(
        rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        version_token("length", "modificationTime").alias("hash"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def _open_store(root: str):
    """Arrow's file system of a root and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _children(store, folder: str, links: bool = False) -> Iterator[tuple[str, bool, int, int]]:
    """Name, whether it is a folder, size and nanoseconds of change of what is in a folder; nothing if it is gone.

    Of a local folder, what is neither file nor folder is left out, and so are links without ``links``: none leads round in
    circles.
    """
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            found = os.scandir(folder)
        except FileNotFoundError:
            return
        with found:
            for x in found:
                if x.is_dir(follow_symlinks=links):
                    yield x.name, True, 0, 0
                elif x.is_file(follow_symlinks=links):
                    try:
                        at = x.stat(follow_symlinks=links)
                    except FileNotFoundError:
                        continue
                    yield x.name, False, at.st_size, at.st_mtime_ns
    else:
        for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime_ns or 0


def _unseen(name: str) -> bool:
    """Names that Spark's readers leave out."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
    return hidden and not name.startswith(("_common_metadata", "_metadata"))


def _expand(root: str, budget: int, as_spark: bool = False):
    """For each folder what is in it; folders within it too, until the folder has given so many rows.

    No more than ``budget`` folders wait at once; others are handed back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), rows = _open_store(root), []
        for batch in batches:
            for start in batch.column(0).to_pylist():
                waiting, given = [start], 0
                while waiting:
                    folder = waiting.pop()
                    if given >= budget:
                        rows.append((folder, True, 0, 0))
                        continue
                    for name, is_folder, size, changed in _children(store, f"{base}/{folder}".rstrip("/"), as_spark):
                        path = f"{folder}/{name}" if folder else name
                        if as_spark and _unseen(name):
                            continue
                        if is_folder and len(waiting) < budget:
                            waiting.append(path)
                        else:
                            rows.append((path, is_folder, size, changed // 1000))
                            given += not is_folder
                        if len(rows) >= 10_000:
                            yield _walked(rows)
                            rows = []
        yield _walked(rows)

    return run


def _walked(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "folder", "size", "changed"])


def walk_entries(spark: SparkSession, root: str, prefix: str = "", ignore: Iterable[str] = (), budget: int = WALKED) -> DataFrame:
    """ENTRY of every file below ``root``/``prefix``, listed by tasks; a missing prefix gives no rows.

    The driver holds no listing: tasks list the folders of a frontier, write files as rows to the shared folder, and hand
    back the folders that they have not come to as the next frontier.  A task follows the folders below one until it has
    listed ``budget`` files, so a deep tree takes few rounds and a wide one is dealt out.  Ignored folders aren't entered.
    The store must be one that Arrow's file systems reach from the executors; of a store other than a local one, a task
    holds the listing of one folder.
    """
    ignore = list(ignore)
    found = _walk(spark, root, prefix, ignore, budget)
    out = _entries(found, F.timestamp_micros("changed"))
    return filter_ignored(out, ignore) if ignore else out


def _walk(spark: SparkSession, root: str, prefix: str, ignore: Iterable[str], budget: int, as_spark: bool = False) -> DataFrame:
    """``path, size, changed`` (microseconds) of the files that tasks have listed."""
    frontier = spark.createDataFrame([(prefix.strip("/"),)], "path string")
    found, tasks = None, 1
    while True:
        rows = frontier.repartition(tasks, "path").mapInArrow(_expand(root, budget, as_spark), "path string, folder boolean, size long, changed long")
        where, tasks = shared_dir(spark), _tasks(spark)
        rows.write.partitionBy("folder").parquet(where)
        made = spark.read.schema("path string, size long, changed long, folder boolean").parquet(where)
        files = made.filter("not folder")
        found = files if found is None else found.unionByName(files)
        frontier = made.filter("folder").select("path")
        if ignore:
            frontier = filter_ignored(frontier, ignore)
        if frontier.isEmpty():
            return found


def _entries(found: DataFrame, mtime: Column) -> DataFrame:
    return found.select("path", "size", mtime.alias("mtime"), version_token("size", mtime).alias("hash"), F.lit(None).cast("map<string,string>").alias("metadata"))


def _tasks(spark: SparkSession) -> int:
    """Tasks for work on files: rows that name them are small, and adaptive execution would put many into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def entries_from_inventory(
    inventory: DataFrame, prefix: str = "", key: str = "key", size: str = "size", tag: str = "etag", modified: str = "last_modified"
) -> DataFrame:
    """ENTRY of an object store's inventory; keys outside the prefix are left out, an absent size is -1, quotes of tags go.

    The tag is whatever the store calls an object's version: an ETag or a SHA-1.
    """
    rel = rel_key(F.col(key), prefix)
    rows = inventory.withColumn("_path", rel).filter(F.coalesce(F.col("_path"), F.lit("")) != "")
    return rows.select(
        F.col("_path").alias("path"), F.coalesce(F.col(size).cast("long"), F.lit(-1)).alias("size"), F.col(modified).cast("timestamp").alias("mtime"),
        trim_etag(F.col(tag)).alias("hash"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def under_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries below the prefix, by whole path segments: ``hot`` doesn't take ``hotel``."""
    return entries.filter(is_under("path", prefix.strip("/")))


def read_companions(spark: SparkSession, root: str, companions: DataFrame, limit: int = COMPANION_BYTES) -> DataFrame:
    """Adds ``content`` (at most ``limit`` bytes) to the rows whose file is there; only their files are opened, in tasks.

    No more than ``limit`` bytes of a file are read, and a task holds about ``HELD`` bytes of contents (or one file).  Rows
    with a null path or without a file are left out.  The store must be one that Arrow's file systems reach from the
    executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_store(root)
        for batch in batches:
            taken, contents, size = [], [], 0

            def out(batch=batch, taken=taken, contents=contents) -> pa.RecordBatch:
                rows = batch.take(pa.array(taken, pa.int64()))
                return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], [*rows.schema.names, "content"])

            for i, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                if path is None:
                    continue
                try:
                    with store.open_input_file(f"{base}/{path}") as file:
                        contents.append(file.read(limit))
                except FileNotFoundError:
                    continue
                taken.append(i)
                size += len(contents[-1])
                if size >= HELD:
                    yield out()
                    taken.clear()
                    contents.clear()
                    size = 0
            yield out()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in companions.schema.fields)
    return companions.repartition(_tasks(spark), "path").mapInArrow(run, f"{kinds}, content binary")


def write_files(rows: DataFrame, root: str) -> None:
    """Writes files below ``root`` in tasks: ``content`` (binary) of the rows of a ``path``, one after another.

    Rows of a path are beside one another in one partition, in their order.  A file has its name when it is whole, so a
    repeated task is harmless.  The store must be one that Arrow's file systems reach from the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_store(root)
        now, file, made, n = None, None, "", 0

        def done() -> None:
            if file is not None:
                file.close()
                store.move(made, f"{base}/{now}")

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path != now:
                    done()
                    now, folder = path, f"{base}/{path}".rsplit("/", 1)[0]
                    store.create_dir(folder, recursive=True)
                    made = f"{folder}/_{uuid.uuid4().hex}"
                    file, n = store.open_output_stream(made), n + 1
                file.write(content.as_buffer())
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def segment_plan(entries: DataFrame, block_size: int = BLOCK, max_blocks: int = MOST_BLOCKS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``path, block, offset, length`` of each block of each file; files of no or unknown size have none.

    A file of more than ``max_blocks`` blocks gets larger ones, of whole mebibytes.
    """
    need = F.ceil(F.col("size") / F.lit(max_blocks))
    wide = F.ceil(need / F.lit(MIB)) * MIB
    block = F.when(F.ceil(F.col("size") / F.lit(block_size)) <= max_blocks, F.lit(block_size)).otherwise(wide).cast("long")
    rows = entries.filter("size > 0").select("path", "size", block.alias("_block"))
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("_block")))))
    offset = F.col("block") * F.col("_block")
    return each.select("path", "block", offset.alias("offset"), F.least("_block", F.col("size") - offset).alias("length"), *(F.col(c) for c in carry))


def segment_counts(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    return entries.select("path", F.greatest(F.lit(0), F.ceil(F.col("size") / F.lit(segment))).cast("long").alias("segments"))


def smallest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy("size", "path")


def copy_assets(entries: DataFrame, source: str, target: str, block_size: int = BLOCK, errors: str = "raise") -> DataFrame:
    """Copies the files of a listing by the blocks of ``segment_plan`` and returns ``path, bytes, error``; tasks hold one block.

    Each block is a row of its own, so blocks of one file are copied by many tasks.  A file that isn't as long as it was
    listed, or is gone, isn't committed: with ``errors="raise"`` the copy fails, with "rows" its row says so and has no
    bytes.  On a local target (a shared mount) blocks are written to their places in one file, elsewhere to files of their
    own that one task puts together, a block at a time; both lie in a folder ``_copy-...`` of the target until they are
    whole, and the file is then renamed, so readers never see half of it and a repeated task is harmless.  Both stores must
    be ones that Arrow's file systems reach from the executors.  Files of unknown size (-1) are one block of whatever they
    hold.
    """
    if errors not in ("raise", "rows"):
        raise ValueError(f"errors is 'raise' or 'rows', not {errors!r}")
    parts = f"_copy-{uuid.uuid4().hex}"

    def one_block(src, base, dst, top, r) -> int:
        from pyarrow import fs

        with src.open_input_file(f"{base}/{r.path}") as a:
            have = a.size()
            if r.size >= 0 and have != r.size:
                raise ValueError(f"{r.path}: listed with {r.size} bytes, has {have}")
            a.seek(r.offset)
            local, n = isinstance(dst, fs.LocalFileSystem), 0
            out = f"{top}/{parts}/{r.path}" if local else f"{top}/{parts}/{r.path}.{r.block}"
            dst.create_dir(out.rsplit("/", 1)[0], recursive=True)
            made = out if local else f"{out}.{uuid.uuid4().hex}"
            b = os.fdopen(os.open(made, os.O_CREAT | os.O_WRONLY), "wb") if local else dst.open_output_stream(made)
            with b:
                if local:
                    b.seek(r.offset)
                while (r.length < 0 or n < r.length) and (data := a.read(block_size if r.length < 0 else min(block_size, r.length - n))):
                    b.write(data)
                    n += len(data)
            if r.length >= 0 and n < r.length:
                raise ValueError(f"{r.path}: {n} of {r.length} bytes from {r.offset} on")
            if not local:
                dst.move(made, out)
        return n

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (src, base), (dst, top) = _open_store(source), _open_store(target)
        for batch in batches:
            sizes, wrong = [], []
            for r in batch.itertuples(index=False):
                try:
                    sizes.append(one_block(src, base, dst, top, r))
                    wrong.append(None)
                except (ValueError, FileNotFoundError) as e:
                    if errors == "raise":
                        raise
                    sizes.append(0)
                    wrong.append(f"{r.path}: not found" if isinstance(e, FileNotFoundError) else str(e))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes, "error": wrong})

    def whole_file(dst, top, r) -> None:
        """Puts a file in its place; its parts are gone if a task before this one has done so."""
        from pyarrow import fs

        out = f"{top}/{r.path}"
        dst.create_dir(out.rsplit("/", 1)[0], recursive=True)
        if isinstance(dst, fs.LocalFileSystem):
            part = f"{top}/{parts}/{r.path}"
            if os.path.exists(part):
                os.truncate(part, r.bytes)
                os.replace(part, out)
                with contextlib.suppress(OSError):
                    os.removedirs(os.path.dirname(part))
            return
        each = [f"{top}/{parts}/{r.path}.{i}" for i in range(r.blocks)]
        left = {x.path for x in dst.get_file_info(each) if x.type != fs.FileType.NotFound}
        if len(left) < len(each):
            return
        made = each[0]
        if len(each) > 1:
            made = f"{top}/{parts}/{r.path}.{uuid.uuid4().hex}"
            with dst.open_output_stream(made) as b:
                for part in each:
                    with dst.open_input_stream(part) as a:
                        while data := a.read(block_size):
                            b.write(data)
        dst.move(made, out)
        for part in left - {made}:
            dst.delete_file(part)

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dst, top = _open_store(target)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.error is None:
                    whole_file(dst, top, r)
            yield batch[["path", "bytes", "error"]]

    rest = entries.filter("size <= 0").select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("offset"), F.greatest(F.col("size"), F.lit(-1)).alias("length"), "size")
    plan = segment_plan(entries, block_size, carry=("size",)).unionByName(rest).repartition(_tasks(entries.sparkSession), "path", "block")
    copied = plan.mapInPandas(blocks, "path string, bytes long, error string")
    bad = F.min("error")
    files = copied.repartition(_tasks(entries.sparkSession), "path").groupBy("path").agg(F.when(bad.isNull(), F.sum("bytes")).otherwise(0).alias("bytes"), F.count("*").alias("blocks"), bad.alias("error"))
    return files.mapInPandas(commit, "path string, bytes long, error string")
