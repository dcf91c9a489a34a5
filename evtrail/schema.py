"""The normalized event: one wide row per record of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("record_index", T.IntegerType()),
        T.StructField("parser_name", T.StringType()),
        T.StructField("parser_version", T.StringType()),
        T.StructField("ingest_time", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
    ]
)
_TEXT = ("source", "event_id", "host", "user", "process_name", "parent_name", "command_line", "src_ip", "dst_ip", "file_path", "registry_key", "raw")
#: timestamp has whole seconds in UTC; timestamp_original is null where the record has no time of its own ("untimed").
EVENT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("timestamp_original", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.LongType()) for n in ("process_id", "parent_id")]
    + [T.StructField(n, T.IntegerType()) for n in ("src_port", "dst_port")]
    + [
        T.StructField("hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("evidence_id", T.LongType()),
        T.StructField("provenance", PROVENANCE),
    ]
)

#: Severities from least to most.
SEVERITIES = ("informational", "low", "medium", "high", "critical")


def severity_rank(c: Column) -> Column:
    out = F.when(F.lower(c) == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(F.lower(c) == name, i)
    return out


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def conform(df, keep_extra: bool = False):  # noqa: ANN001, ANN201
    """df with every event column in its type; columns that it lacks are null (maps and arrays empty)."""
    empty = {"hashes": F.create_map().cast("map<string,string>"), "flags": F.array().cast("array<string>")}
    have = set(df.columns)
    own = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else empty.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in EVENT]
    extra = [F.col(f"`{c}`") for c in df.columns if c not in EVENT.names] if keep_extra else []
    return df.select(*own, *extra)
