"""Event query, timeline, coverage, summaries (survey C1-C3, C8, H1, J1-J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import iso

#: Limits of the reference's commands.
EVENT_LIMIT, TIMELINE_LIMIT, MOST = 200, 500, 10_000


def order(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "id")


def _is(name: str, value: str) -> Column:
    return F.lower(F.col(name)) == value.lower()


def events_where(events: DataFrame, host: str | None = None, user: str | None = None, process: str | None = None, event_id: str | None = None, keyword: str | None = None) -> DataFrame:
    """All events that meet every condition given; a keyword's % and _ are wildcards."""
    out = events
    for name, value in (("host", host), ("user", user), ("process_name", process)):
        if value is not None:
            out = out.filter(_is(name, value))
    if event_id is not None:
        out = out.filter(F.col("event_id") == event_id)
    if keyword is not None:
        like = f"%{keyword.lower()}%"
        out = out.filter(F.lower("command_line").like(like) | F.lower("file_path").like(like) | F.lower("registry_key").like(like) | F.lower("raw").like(like))
    return out


def page(events: DataFrame, limit: int = EVENT_LIMIT, offset: int = 0) -> DataFrame:
    if offset < 0:
        raise ValueError("offset below 0")
    return order(events).offset(offset).limit(max(1, min(limit, MOST)))


def page_after(events: DataFrame, after: tuple[str | None, int] | None, limit: int = EVENT_LIMIT) -> DataFrame:
    """The next page behind the event (timestamp, id) that the last one ended with.

    Unlike an offset it sorts no earlier page again: what lies before is left out by a bound on the time, which
    reaches the files. Events without a timestamp come first, as in order().
    """
    out = events
    if after is not None:
        at, last = after
        if at is None:
            out = out.filter(F.col("timestamp").isNotNull() | (F.col("id") > last))
        else:
            t = F.lit(at).cast("timestamp")
            out = out.filter((F.col("timestamp") >= t) & ((F.col("timestamp") > t) | (F.col("id") > last)))
    return order(out).limit(max(1, min(limit, MOST)))


def timed() -> Column:
    return F.coalesce(F.col("timestamp_original"), F.lit("")) != ""


def summary() -> Column:
    """One line on what an event shows (C2)."""
    e = F.col
    text = lambda c, d: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(d))
    has = lambda n: F.coalesce(e(n), F.lit("")) != ""
    proc, pid = text(e("process_name"), "-"), e("process_id").cast("string")
    bit = F.when(pid.isNotNull(), F.concat(proc, F.lit("("), pid, F.lit(")"))).otherwise(proc)
    named = F.concat(proc, F.lit("("), F.coalesce(pid, F.lit("None")), F.lit(")"))
    raw, kind = F.coalesce(e("raw"), F.lit("")), text(e("event_id"), "?")
    runs = F.regexp_extract(raw, r"run_count=\d+", 0)
    first = F.nullif(F.substring_index(raw, ",", 1), F.lit(""))
    source = text(e("source"), "?")
    return (
        F.when((kind == "1") & has("parent_name"), F.concat(named, F.lit(" started by "), e("parent_name"), F.lit("("), F.coalesce(e("parent_id").cast("string"), F.lit("None")), F.lit(")")))
        .when((kind == "4688") & has("parent_name"), F.concat(named, F.lit(" created (parent "), e("parent_name"), F.lit(")")))
        .when((kind == "3") & has("dst_ip"), F.concat(bit, F.lit(" -> "), e("dst_ip"), F.lit(":"), F.coalesce(F.nullif(e("dst_port"), F.lit(0)).cast("string"), F.lit("?")), F.lit(" (from "), text(e("src_ip"), "?"), F.lit(")")))
        .when((kind == "11") & has("file_path"), F.concat(bit, F.lit(" created file "), e("file_path")))
        .when(kind.isin("12", "13", "14") & has("registry_key"), F.concat(bit, F.lit(" registry "), e("registry_key")))
        .when(kind == "4104", F.concat(bit, F.lit(" logged script block ("), F.length(raw).cast("string"), F.lit(" chars)")))
        .when(source.startswith("prefetch"), F.concat(proc, F.lit(" executed (prefetch evidence"), F.when(runs != "", F.concat(F.lit(", "), runs)).otherwise(""), F.lit(")")))
        .when(source.startswith("registry"), F.concat(F.lit("persistence: "), F.coalesce(F.nullif(e("registry_key"), F.lit("")), kind)))
        .when(source == "tasks", F.concat(F.lit("scheduled task: "), F.coalesce(first, kind)))
        .when(source == "services", F.concat(F.lit("service: "), F.coalesce(first, kind)))
        .otherwise(F.concat(source, F.lit(":"), kind, F.lit(" host="), text(e("host"), "-"), F.lit(" user="), text(e("user"), "-"), F.lit(" process="), bit))
    )


def event_line() -> Column:
    """The line that narratives quote (C3)."""
    e = F.col
    some = lambda n: F.nullif(e(n), F.lit(""))
    proc = F.concat(some("process_name"), F.coalesce(F.concat(F.lit(" (pid "), e("process_id").cast("string"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), F.substring(some("command_line"), 1, 80)), F.lit("")))
    net = F.concat(F.lit("-> "), some("dst_ip"), F.lit(":"), F.coalesce(F.nullif(e("dst_port"), F.lit(0)).cast("string"), F.lit("?")))
    bits = F.concat_ws("; ", proc, F.concat(F.lit("file "), some("file_path")), F.concat(F.lit("registry "), some("registry_key")), net)
    detail = F.when(bits != "", bits).otherwise(F.substring(F.coalesce(e("raw"), F.lit("")), 1, 80))
    return F.trim(F.concat(e("source"), F.lit(":"), e("event_id"), F.lit(" "), detail))


def in_scope(events: DataFrame, start: str | None = None, end: str | None = None, source: str | None = None) -> DataFrame:
    """Events of a source prefix, with untimed ones left out where a bound is set."""
    if start is not None and end is not None and start > end:
        raise ValueError("the time range ends before it starts")
    out = events
    if source is not None:
        out = out.filter(F.lower("source").startswith(source.lower()))
    if start is not None:
        out = out.filter(timed() & (F.col("timestamp") >= F.lit(start).cast("timestamp")))
    if end is not None:
        out = out.filter(timed() & (F.col("timestamp") <= F.lit(end).cast("timestamp")))
    return out


def timeline(events: DataFrame, start: str | None = None, end: str | None = None, source: str | None = None) -> DataFrame:
    """Entries of the timeline, in no order; timed says which part each belongs to. Order and limit with page()."""
    own = in_scope(events, start, end, source)
    return own.select("id", "timestamp", "timestamp_original", "source", "event_id", "host", "user", "process_name", "process_id", summary().alias("summary"), timed().alias("timed"), "flags")


def coverage(events: DataFrame) -> DataFrame:
    """Events of each source with first and last time (H1)."""
    return events.groupBy("source").agg(F.count("*").alias("events"), iso(F.min("timestamp")).alias("first"), iso(F.max("timestamp")).alias("last"))


def highlights(events: DataFrame, n: int = 10) -> DataFrame:
    """The first and the last n timed events (J3)."""
    own = events.filter(timed()).select("id", "timestamp", summary().alias("summary"))
    first = own.orderBy("timestamp", "id").limit(n).withColumn("end", F.lit("first"))
    last = own.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).withColumn("end", F.lit("last"))
    return first.unionByName(last)
