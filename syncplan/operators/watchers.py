"""Watchers and who owns a path: J1 and F3."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_under

#: Up to so many watchers become one CASE; more are joined through each path's ancestors.
MOST_CASES = 64


@dataclass(frozen=True)
class Watcher:
    prefix: str
    poll_seconds: float


def normalize_watchers(watchers: Iterable[Watcher], default_seconds: float | None = None) -> list[Watcher]:
    """Prefixes without spaces and slashes at their ends; a root watcher is added if a default interval is given."""
    out: dict[str, Watcher] = {}
    for w in watchers:
        prefix = w.prefix.strip().strip("/")
        if w.poll_seconds <= 0:
            raise ValueError(f"watcher {prefix!r}: the interval must be above 0")
        if prefix in out:
            raise ValueError(f"watcher {prefix!r} is given twice")
        out[prefix] = Watcher(prefix, w.poll_seconds)
    if default_seconds is not None and "" not in out:
        out[""] = Watcher("", default_seconds)
    return sorted(out.values(), key=lambda w: (-len(w.prefix), w.prefix))


def sub_prefixes(watchers: Iterable[Watcher], prefix: str) -> list[str]:
    """Prefixes of other watchers below this one."""
    return sorted(w.prefix for w in watchers if w.prefix != prefix and (not prefix or w.prefix.startswith(prefix + "/")))


def assign_watcher(entries: DataFrame, watchers: Iterable[Watcher] | DataFrame, path: str = "path") -> DataFrame:
    """Adds ``watcher``: the longest prefix that is the path or a directory above it; null if no watcher owns it.

    ``watchers`` as a DataFrame has a column ``prefix``; it is joined through the ancestors of each path and adaptive
    execution broadcasts it if it is small.
    """
    if not isinstance(watchers, DataFrame):
        listed = sorted(watchers, key=lambda w: -len(w.prefix))
        if len(listed) <= MOST_CASES:
            owner = F.lit(None).cast("string")
            for w in reversed(listed):
                owner = F.when(is_under(path, w.prefix), F.lit(w.prefix)).otherwise(owner)
            return entries.withColumn("watcher", owner)
        watchers = entries.sparkSession.createDataFrame([(w.prefix,) for w in listed], "prefix string")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = entries.select(path).distinct().withColumn("prefix", F.explode(above))
    owned = paths.join(watchers.select("prefix").distinct(), "prefix").groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias("watcher"))
    return entries.join(owned, path, "left")
