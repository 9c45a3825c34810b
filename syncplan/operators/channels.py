"""Channels and where events go: F4 to F7, J3, J5, J7, J8, J16 and U4."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..schemas import DELETE, KINDS
from .companions import CompanionPattern, match_companions
from .synclog import latest


@dataclass(frozen=True)
class Channel:
    """A binding of a source to a destination.

    ``filter`` is a Spark SQL condition over kind, path, size, connector and metadata; empty means always.  ``event`` and
    ``events`` name trigger kinds; exactly one of them is given.
    """

    name: str
    source: str
    destination: str = ""
    event: str | None = None
    events: tuple[str, ...] | None = None
    filter: str = ""
    companions: tuple[CompanionPattern, ...] = ()
    enriches: bool = False
    kinds: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if (self.event is None) == (self.events is None):
            raise ValueError(f"channel {self.name!r}: give exactly one of event and events")
        kinds = (self.event,) if self.event is not None else tuple(self.events)
        if not kinds:
            raise ValueError(f"channel {self.name!r}: events is empty")
        if len(set(kinds)) < len(kinds):
            raise ValueError(f"channel {self.name!r}: a kind is given twice")
        if unknown := [k for k in kinds if k not in KINDS]:
            raise ValueError(f"channel {self.name!r}: unknown kinds {unknown}")
        object.__setattr__(self, "kinds", kinds)

    def fires_on(self) -> Column:
        """The event's source and kind are the channel's; the filter isn't asked."""
        return (F.col("connector") == self.source) & F.col("kind").isin(*self.kinds)

    def accepts(self) -> Column:
        """``fires_on`` and the filter; a null counts as false."""
        own = F.coalesce(F.expr(self.filter), F.lit(False)) if self.filter.strip() else F.lit(True)
        return self.fires_on() & own


def check_filter(events: DataFrame, condition: str) -> None:
    """Raises unless the condition is a boolean over the events' columns."""
    kind = events.select(F.expr(condition)).schema[0].dataType.simpleString()
    if kind != "boolean":
        raise ValueError(f"the filter gives {kind}, not boolean: {condition}")


def route(events: DataFrame, channels: Iterable[Channel]) -> DataFrame:
    """Each event once for every channel that accepts it, with ``channel_name`` and ``destination``.  One pass over events."""
    hits = [F.when(c.accepts(), F.struct(F.lit(c.name).alias("channel_name"), F.lit(c.destination).alias("destination"))) for c in channels]
    if not hits:
        return events.withColumn("channel_name", F.lit("")).withColumn("destination", F.lit("")).limit(0)
    out = events.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return out.select(*events.columns, "_hit.*")


def split_companions(events: DataFrame, channels: Iterable[Channel]) -> tuple[DataFrame, DataFrame]:
    """(assets, companions): an event that any channel of its source claims as companion leaves the flow of assets."""
    marked = match_companions(events, [(c.name, c.source, c.companions) for c in channels])
    assets = marked.filter(F.size("matches") == 0).drop("matches")
    companions = marked.filter(F.size("matches") > 0).select(*events.columns, F.explode("matches").alias("m"))
    return assets, companions.select(*events.columns, "m.*")


def shadowed_assets(events: DataFrame, channels: Iterable[Channel]) -> DataFrame:
    """``path, channels``: companions that some channels would have accepted as assets."""
    channels = list(channels)
    _, companions = split_companions(events, channels)
    rows = companions.select(*events.columns).distinct() if "metadata" not in events.columns else companions.dropDuplicates(["path", "kind"])
    routed = route(rows.select(*events.columns), channels)
    return routed.groupBy("path").agg(F.array_sort(F.collect_set("channel_name")).alias("channels"))


def plan_assets(routed: DataFrame, log: DataFrame) -> DataFrame:
    """Creates and updates: routed events with the record that their path has in the log.

    Events whose version is the logged one are left out; ``work_kind`` follows from a prior record, not from the event.
    """
    prior = latest(log).select("channel_name", F.col("source_path").alias("path"), F.col("source_version").alias("prior_version"), "dest_id")
    joined = routed.filter(F.col("kind") != DELETE).join(prior, ["channel_name", "path"], "left")
    unchanged = (F.col("prior_version") == F.col("hash")) & (F.coalesce("hash", F.lit("")) != "")
    fresh = joined.filter(~F.coalesce(unchanged, F.lit(False)))
    return fresh.withColumn("work_kind", F.when(F.coalesce("dest_id", F.lit("")) == "", "create").otherwise("update"))


def plan_deletes(events: DataFrame, channels: Iterable[Channel], log: DataFrame) -> DataFrame:
    """Delete events on channels that enrich and fire on deletes, where the path has a record: patches, never removals."""
    firing = [c for c in channels if c.enriches and DELETE in c.kinds]
    names = F.array_compact(F.array(*(F.when(c.fires_on(), F.lit(c.name)) for c in firing))) if firing else F.array().cast("array<string>")
    rows = events.filter(F.col("kind") == DELETE).withColumn("channel_name", F.explode(names))
    prior = latest(log).filter(F.coalesce("dest_id", F.lit("")) != "").select("channel_name", F.col("source_path").alias("path"), "dest_id")
    return rows.join(prior, ["channel_name", "path"]).withColumn("extension", extension("path")).withColumn("work_kind", F.lit("enrich"))


def work_table(*plans: DataFrame) -> DataFrame:
    """All plans in one table; columns that a plan lacks are null."""
    out = plans[0]
    for plan in plans[1:]:
        out = out.unionByName(plan, allowMissingColumns=True)
    return out
