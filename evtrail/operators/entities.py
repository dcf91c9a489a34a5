"""Entity resolution: seven kinds unpivoted, normalised and counted (survey H3, H4, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_user
from ..schema import iso
from .query import timed

KINDS = ("host", "user", "ip", "process", "file", "hash", "registry")


def observations(events: DataFrame, *keys: str) -> DataFrame:
    """A row for each entity that an event names: keys, type, value, observed, source, timestamp, timed."""
    e = F.col
    plain = lambda n: F.lower(F.trim(e(n)))
    one = lambda kind, value, raw: F.struct(F.lit(kind).alias("type"), value.alias("value"), raw.alias("observed"))
    fixed = [one("host", plain("host"), e("host")), one("user", normalize_user(e("user")), e("user")), one("ip", plain("src_ip"), e("src_ip")), one("ip", plain("dst_ip"), e("dst_ip")), one("process", plain("process_name"), e("process_name")), one("file", plain("file_path"), e("file_path")), one("registry", plain("registry_key"), e("registry_key"))]
    hashes = F.transform(F.map_entries(F.coalesce(e("hashes"), F.create_map().cast("map<string,string>"))), lambda h: F.struct(F.lit("hash").alias("type"), F.concat(F.lower(F.trim(h["key"])), F.lit(":"), F.lower(F.trim(h["value"]))).alias("value"), F.concat(h["key"], F.lit(":"), h["value"]).alias("observed")))
    found = events.select(*keys, "source", "timestamp", timed().alias("timed"), F.explode(F.concat(F.array(*fixed), hashes)).alias("x"))
    return found.select(*keys, "source", "timestamp", "timed", "x.*").filter(F.coalesce("value", F.lit("")) != "")


def entities(events: DataFrame, kind: str | None = None) -> DataFrame:
    """type, value, observed_as, count, sources, first_seen and last_seen of timed events."""
    rows = observations(events)
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    when = F.when(F.col("timed"), F.col("timestamp"))
    return rows.groupBy("type", "value").agg(
        F.array_sort(F.collect_set("observed")).alias("observed_as"),
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        iso(F.min(when)).alias("first_seen"),
        iso(F.max(when)).alias("last_seen"),
    )


def cluster_entities(members: DataFrame, events: DataFrame) -> DataFrame:
    """cluster_id, type, value, count. members: (cluster_id, id)."""
    return observations(events.join(members, "id"), "cluster_id").groupBy("cluster_id", "type", "value").agg(F.count("*").alias("count"))
