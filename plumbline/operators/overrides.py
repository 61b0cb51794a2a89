"""Overrides as events over zones (J2-J4, R4-R8, W8, F24): the latest event of a key wins; scope, then nets, then names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import filled
from .windows import dealt, latest_per_key


def current(events: DataFrame, keys: list[str], value: str, order: list[str], job: str = "job_id", reset: str = "reset") -> DataFrame:
    """The value in force per key. A null value clears it; a reset event of the job clears all before it."""
    fence = events.filter(F.coalesce(F.col(reset), F.lit(False))).groupBy(job).agg(F.max(F.struct(*order)).alias("__f"))
    live = events.filter(~F.coalesce(F.col(reset), F.lit(False))).join(fence, job, "left").filter(F.col("__f").isNull() | (F.struct(*order) > F.col("__f")))
    own = live.select(*dict.fromkeys([job, *keys, value, *order]))
    return latest_per_key(own, list(dict.fromkeys([job, *keys])), order).filter(F.col(value).isNotNull()).select(*dict.fromkeys([job, *keys]), value)


def with_scope(zones: DataFrame, groups: DataFrame, pages: DataFrame, job: str = "job_id", group: str = "group", page: str = "page") -> DataFrame:
    """In scope unless the group or the page was switched off; rows are parked, never dropped."""
    g = groups.select(job, F.col("key").alias(group), F.col("in_scope").alias("__g"))
    p = pages.select(job, F.col("key").try_cast("int").alias(page), F.col("in_scope").alias("__p"))
    on = F.coalesce(F.col("__g"), F.lit(True)) & F.coalesce(F.col("__p"), F.lit(True))
    return zones.join(g, [job, group], "left").join(p, [job, page], "left").withColumn("in_scope", on).drop("__g", "__p")


def with_nets(zones: DataFrame, nets: DataFrame, keys: list[str], auto: str = "net_area") -> DataFrame:
    """The set value, or the machine's again where none is in force."""
    return zones.join(nets.select(*keys, F.col("net").alias("__n")), keys, "left").withColumn("final_net", F.coalesce("__n", auto)).withColumn("overridden", F.col("__n").isNotNull()).drop("__n")


def with_names(zones: DataFrame, names: DataFrame, keys: list[str], machine: str = "material") -> DataFrame:
    """Display only; keys never change."""
    return zones.join(names.select(*keys, F.col("name").alias("__m")), keys, "left").withColumn("display_name", F.coalesce(filled(F.col("__m")), F.col(machine))).drop("__m")


def view(zones: DataFrame, groups: DataFrame, pages: DataFrame, nets: DataFrame, names: DataFrame) -> DataFrame:
    """The zones as they stand: scope, nets and names in that order."""
    return with_names(with_nets(with_scope(zones, groups, pages), nets, ["job_id", "page", "group"]), names, ["job_id", "group"])


def job_states(events: DataFrame, job: str, state: str, order: list[str], restarts: DataFrame | None = None) -> DataFrame:
    """The last state of each job; jobs left queued or running before a restart are errors."""
    last = latest_per_key(events, [job], order).drop("hits")
    if restarts is None:
        return last
    edge = restarts.agg(F.max("ts").alias("__t"))
    orphan = F.col(state).isin("queued", "running") & (F.col(order[0]) < F.col("__t"))
    return last.join(F.broadcast(edge), F.lit(True), "left").withColumn(state, F.when(orphan, "error").otherwise(F.col(state))).drop("__t")


def checked_value(value: str, low: float = 0.0) -> object:
    """a value that is missing or below the bound stops the job with a message."""
    v = F.col(value)
    return F.when(v.isNull() | (v < low), F.raise_error(F.concat(F.lit(f"{value} must be a number of {low} or more: "), F.coalesce(v.cast("string"), F.lit("null"))))).otherwise(v)


# Fixed value: the name that an accepted suggestion takes.
ACCEPTED = "AI wall (accepted)"


def with_accepted(pieces: DataFrame, events: DataFrame, keys: list[str], order: list[str], material: str = "material") -> DataFrame:
    """The latest event of a suggested piece decides: accepted, it is booked under the accepted name, and before_accept keeps its
    own; undone, it is the suggestion again. Events of pieces that were never suggested change nothing. events: keys, undo, order."""
    last = latest_per_key(events.select(*keys, "undo", *order), keys, order).select(*keys, (~F.col("undo")).alias("__a"))
    on = F.coalesce(F.col("suggest_only"), F.lit(False)) & F.coalesce(F.col("__a"), F.lit(False))
    out = pieces.join(last, keys, "left").withColumn("before_accept", F.when(on, F.col(material)))
    return out.withColumns({material: F.when(on, ACCEPTED).otherwise(F.col(material)), "suggest_only": F.coalesce(F.col("suggest_only"), F.lit(False)) & ~on}).drop("__a")


def confirmations(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The keys whose latest event confirms them, and when. Display alone: no sum reads it."""
    last = latest_per_key(events.select(*dict.fromkeys([*keys, "confirmed", *order])), keys, order)
    return last.filter(F.coalesce(F.col("confirmed"), F.lit(True))).select(*dict.fromkeys([*keys, order[0]]))


def parked(zones: DataFrame, keys: list[str], order: list[str], index: str = "scope_index") -> DataFrame:
    """Zones with their place in the list, kept while they are parked."""
    return dealt(zones, keys).withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def restored(live: DataFrame, back: DataFrame, keys: list[str], index: str = "scope_index") -> DataFrame:
    """Parked zones among the live ones at their old places: `position` in the list, ties by the index alone."""
    return live.unionByName(back).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1)
