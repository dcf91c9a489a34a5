"""Summaries that are merged from parts: a state for each batch of events instead of another scan of them all (survey H1, H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import iso
from .entities import observations

COVERAGE = "source string, events long, first timestamp, last timestamp"
ENTITIES = "type string, value string, observed array<string>, events long, sources array<string>, first timestamp, last timestamp"


def coverage_part(events: DataFrame, *keys: str) -> DataFrame:
    """Columns COVERAGE: a row for each source, and for each of keys."""
    return events.groupBy(*keys, "source").agg(F.count("*").alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def coverage(parts: DataFrame) -> DataFrame:
    """query.coverage() of the events that parts were made of."""
    return parts.groupBy("source").agg(F.sum("events").alias("events"), iso(F.min("first")).alias("first"), iso(F.max("last")).alias("last"))


def merged_coverage(parts: DataFrame) -> DataFrame:
    """One part of many."""
    return parts.groupBy("source").agg(F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))


def entity_part(events: DataFrame, *keys: str) -> DataFrame:
    """Columns ENTITIES: a row for each entity, and for each of keys."""
    when = F.when(F.col("timed"), F.col("timestamp"))
    return observations(events, *keys).groupBy(*keys, "type", "value").agg(
        F.collect_set("observed").alias("observed"), F.count("*").alias("events"), F.collect_set("source").alias("sources"), F.min(when).alias("first"), F.max(when).alias("last")
    )


def merged_entities(parts: DataFrame) -> DataFrame:
    """One part of many; forms and sources that several parts hold are named once."""
    forms = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    return parts.groupBy("type", "value").agg(forms("observed").alias("observed"), F.sum("events").alias("events"), forms("sources").alias("sources"), F.min("first").alias("first"), F.max("last").alias("last"))


def entities(parts: DataFrame, kind: str | None = None) -> DataFrame:
    """entities.entities() of the events that parts were made of."""
    own = parts if kind is None else parts.filter(F.col("type") == kind)
    return merged_entities(own).select("type", "value", F.array_sort("observed").alias("observed_as"), F.col("events").alias("count"), F.array_sort("sources").alias("sources"), iso(F.col("first")).alias("first_seen"), iso(F.col("last")).alias("last_seen"))
