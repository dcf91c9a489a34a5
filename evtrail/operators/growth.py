"""Clusters that grow with what is appended: links of old events aren't made again (survey E1, E6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_written, written
from .correlate import PREFETCH_GAP, components, persist_sides, point_edges, points, prepared

LABELS, HUBS = "id long, root long", "kind string, h string, key string, id long"
#: Groups whose events are all linked: a kind of member, and the kind that it is linked to.
ACROSS = {"path": "path", "path-kept": "path-ran", "path-ran": "path-kept", "name-kept": "name-ran", "name-ran": "name-kept"}


def memberships(p: DataFrame) -> DataFrame:
    """(kind, h, key, id): the groups that prepared events are in."""
    keep, ran = persist_sides(p)
    of = lambda df, kind, key, i, h="h": df.filter(f"{key} <> ''").select(F.lit(kind).alias("kind"), F.col(h).alias("h") if h else F.lit("").alias("h"), F.col(key).alias("key"), F.col(i).alias("id"))
    rows = [of(p.filter("timed"), "path", "path", "id", None), of(keep, "path-kept", "tp", "a"), of(ran, "path-ran", "path", "b"), of(keep, "name-kept", "tb", "a"), of(ran, "name-ran", "xb", "b")]
    return reduce(DataFrame.unionByName, rows).filter("h IS NOT NULL")


def _facing(hubs: DataFrame) -> DataFrame:
    """hubs by the kind of those that are linked to them: (kind, h, key, hub)."""
    other = F.create_map(*[F.lit(x) for pair in ACROSS.items() for x in pair])
    return hubs.select(other[F.col("kind")].alias("kind"), "h", "key", F.col("id").alias("hub"))


def _group_edges(old: DataFrame, hubs: DataFrame, p_new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that new members bring, and the hubs with them: of each kind a group's least member of the append that began it, which stays.

    A new member is linked to the hub on the other side. Where new events bring a group its first member of one kind,
    the old members of the other are asked for once; that happens once in a group's life.
    """
    on = ["kind", "h", "key"]
    own = written(memberships(p_new))
    begun = own.groupBy(*on).agg(F.min("id").alias("id"))
    now = written(hubs.unionByName(begun.join(hubs.select(*on), on, "left_anti")))
    edges = own.join(_facing(now), on).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    brought = _facing(begun.filter("kind <> 'path'")).join(_facing(hubs).select(*on), on, "left_anti")
    late = written(brought.join(hubs.select(*on), on, "left_semi"))
    if late.head(1):
        first = memberships(prepared(old)).join(late, on).select(F.col("id").alias("a"), F.col("hub").alias("b"))
        edges = edges.unionByName(first)
    return edges, now


def grow(old: DataFrame, labels: DataFrame, hubs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, hubs) of old and new events together, from those of the old ones; empty ones to begin with.

    labels are (id, root) as correlate.clusters() gives them. Links in time are sought among new events and the old
    ones of the same host up to two hours around them; a link can reach no further than one. Between two old events
    they may be found again, which changes nothing. Old labels take part as edges to their clusters.
    """
    p_new = written(prepared(new))
    bucket = F.floor(F.col("s") / PREFETCH_GAP)
    around = p_new.filter("timed").select("h", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b")).distinct()
    near = prepared(old).filter("timed").withColumn("_b", bucket).join(around, ["h", "_b"], "left_semi").drop("_b")
    both = written(near.unionByName(p_new))
    edges, now = _group_edges(old, hubs, p_new)
    w = written(points(both))
    drop_written(p_new, both)
    # A label leads from its event to its cluster, as an edge.
    known = labels.select(F.col("id").alias("a"), F.col("root").alias("b"))
    joined = components(edges.unionByName(point_edges(w)).unionByName(known))
    drop_written(w)
    return joined, now
