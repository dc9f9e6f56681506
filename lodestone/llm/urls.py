"""URL filters against dated block and allow lists, in DataFrame expressions only.

A list event says that an entry was blocked, allowed or removed on a day.  Events
become validity intervals (an entry's state holds until its next event), and every
capture is judged by the intervals that hold on the day it was fetched, by an as-of
join.  An entry is a domain, which covers its subdomains, or a host with leading
path segments; the most specific entry that holds decides.

The verdict depends on host, leading path segments and day alone, so captures are
reduced to these before anything is shuffled by list entry, and the as-of join sees
each (entry, day) once: a host with a third of all captures has as many rows there
as days.

A URL that is null or has no host has verdict ``invalid``; one without a holding
entry, or without a fetch day, is ``unlisted``.  Events with a null entry, day or
unknown action are no events; of several on one day the strictest counts (block,
allow, remove).  Rows with equal ids are judged one by one.  Other columns of the
captures are kept, except those named like a result column.  A URL of any length is
read whole.  No captures give no rows; no events leave every host unlisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import work_path

RESULT = ("host", "verdict", "entry", "category", "valid_from", "valid_to")

_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def segments_of(url: Column) -> Column:
    """The segments of the path that are not empty."""
    return F.array_remove(F.split(F.regexp_extract(url, _PATH, 1), "/"), "")


def _entry(text: Column) -> Column:
    """A list entry in canonical form: host in lower case, segments without empty ones."""
    parts = F.array_remove(F.split(F.trim(text), "/"), "")
    host = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"\.+$", "")
    return F.array_join(F.concat(F.array(host), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def intervals(events: DataFrame) -> DataFrame:
    """``entry, valid_from, valid_to, action, category`` from ``events(entry, day, action, category)``.

    ``valid_to`` is exclusive and null while the state holds.  An entry has at most
    one event a day after combining, so its rows are bounded by days.
    """
    severity = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    state = F.struct(severity.alias("severity"), F.col("action").alias("action"), F.col("category").alias("category"))
    daily = (
        events.select(_entry(F.col("entry")).alias("entry"), F.col("day").cast("date").alias("valid_from"), state.alias("state"))
        .where("length(entry) > 0 AND valid_from IS NOT NULL AND state.severity IS NOT NULL")
        .groupBy("entry", "valid_from")
        .agg(F.max("state").alias("state"))
    )
    following = F.lead("valid_from").over(Window.partitionBy("entry").orderBy("valid_from"))
    return daily.select("entry", "valid_from", following.alias("valid_to"), "state.action", "state.category")


def _candidates(host: Column, lead: Column, labels: int, depth: int) -> Column:
    """Entries that would cover a capture, with their specificity: parent domains, host, host with segments."""
    parts = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.struct(n.alias("rank"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".").alias("entry")),
    )
    # An entry may name the host itself with more labels than any parent domain.
    paths = F.transform(
        F.sequence(F.lit(1), F.size(lead)),
        lambda n: F.struct((n + 1000).alias("rank"), F.concat(host, F.lit("/"), F.array_join(F.slice(lead, F.lit(1), n), "/")).alias("entry")),
    )
    return F.when(F.size(lead) > 0, F.concat(domains, paths)).otherwise(domains) if depth else domains


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with host, verdict and the entry, category and interval that decided.

    Two numbers about the list reach the driver: the most labels and the most
    segments of an entry, so that no longer candidate is ever made.
    """
    path = work_path(captures.sparkSession, "url-intervals")
    intervals(events).write.parquet(path)
    listed = captures.sparkSession.read.parquet(path)
    shape = listed.agg(
        F.max(F.size(F.split(F.element_at(F.split("entry", "/"), 1), r"\."))).alias("labels"),
        F.max(F.size(F.split("entry", "/")) - 1).alias("depth"),
    ).first()
    labels, depth = shape.labels or 1, shape.depth or 0

    kept = [c for c in captures.columns if c not in RESULT]
    lead = F.slice(segments_of(F.col(url)), F.lit(1), F.lit(depth)) if depth else F.array().cast("array<string>")
    row = F.struct(*[f"`{c}`" for c in kept]).alias("row")  # one value, so that the captures' columns may have any names
    known = captures.select(
        row, host_of(F.col(url)).alias("host"), F.array_join(lead, "/").alias("_lead"), F.col(fetched).cast("date").alias("_day")
    )
    places = known.where("host IS NOT NULL AND _day IS NOT NULL").select("host", "_lead", "_day").distinct()
    split_lead = F.array_remove(F.split("_lead", "/"), "")
    asked = places.select("*", F.explode(_candidates(F.col("host"), split_lead, labels, depth)).alias("c"))
    asked = asked.select("host", "_lead", "_day", "c.rank", "c.entry")

    # As-of join: probes and interval starts in one order per entry; a probe takes the last start before it.
    start = F.struct("valid_from", "valid_to", "action", "category")
    starts = listed.select("entry", F.col("valid_from").alias("_day"), F.lit(0).alias("probe"), start.alias("state"))
    probes = asked.select("entry", "_day").distinct()
    # Probes of entries that no list has are dropped before they are sorted.
    probes = probes.join(listed.select("entry").distinct(), "entry", "left_semi")
    probes = probes.select("entry", "_day", F.lit(1).alias("probe"), F.lit(None).cast(starts.schema["state"].dataType).alias("state"))
    order = Window.partitionBy("entry").orderBy("_day", "probe").rowsBetween(Window.unboundedPreceding, 0)
    timeline = starts.unionByName(probes).withColumn("state", F.last("state", ignorenulls=True).over(order))
    holding = timeline.where("probe = 1 AND state.action != 'remove'").where(
        "state.valid_to IS NULL OR _day < state.valid_to"
    )
    best = F.max(F.struct("rank", "entry", "state")).alias("best")
    found = asked.join(holding.select("entry", "_day", "state"), ["entry", "_day"]).groupBy("host", "_lead", "_day").agg(best)

    out = known.join(found, ["host", "_lead", "_day"], "left")
    state = F.col("best.state")
    verdict = (
        F.when(F.col("host").isNull(), "invalid")
        .when(state["action"] == "block", "blocked")
        .when(state["action"] == "allow", "allowed")
        .otherwise("unlisted")
    )
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        "host",
        verdict.alias("verdict"),
        F.col("best.entry").alias("entry"),
        state["category"].alias("category"),
        state["valid_from"].alias("valid_from"),
        state["valid_to"].alias("valid_to"),
    )
