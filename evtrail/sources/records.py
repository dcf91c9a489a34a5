"""JSONL records in and out (survey A16, B3, B5, B6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_safe, normalize_timestamp
from ..schema import EVENT, conform, iso

#: Fixed value: longer lines are skipped.
LONGEST_LINE = 1_000_000
_TEXT = "struct<" + ",".join(f"{f.name}:{'string' if f.name not in ('hashes', 'flags', 'provenance') else f.dataType.simpleString()}" for f in EVENT) + ">"


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """lines (value) as (event columns, error): error is null where a line holds a usable event. Blank lines go."""
    own = lines.filter(F.trim("value") != "")
    parsed = own.withColumn("_r", F.when(F.length("value") <= LONGEST_LINE, F.from_json("value", _TEXT)))
    r = F.col("_r")
    whole = lambda n: r[n].isNull() | r[n].try_cast("long").isNotNull()
    error = (
        F.when(F.length("value") > LONGEST_LINE, "line too long")
        .when(r.isNull() | ~F.ltrim("value").startswith("{"), "not a JSON object")
        .when(F.coalesce(r["source"], F.lit("")) == "", "no source")
        .when(F.coalesce(r["event_id"], F.lit("")) == "", "no event_id")
        .when(normalize_timestamp(r["timestamp"]).isNull(), "bad timestamp")
        .when(~(whole("process_id") & whole("parent_id") & whole("src_port") & whole("dst_port")), "bad number")
    )
    numbers = ("id", "process_id", "parent_id", "src_port", "dst_port", "evidence_id")
    columns = [normalize_timestamp(r["timestamp"]).alias("timestamp")] + [(r[f.name].try_cast(f.dataType) if f.name in numbers else r[f.name]).alias(f.name) for f in EVENT if f.name != "timestamp"]
    return conform(parsed.select(*columns, error.alias("error")), keep_extra=True)


def load_jsonl(spark, path: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(events, rejected lines' errors)"""
    both = parse_jsonl(spark.read.text(path))
    return both.filter("error IS NULL").drop("error"), both.filter("error IS NOT NULL").select("error")


EXPORTED = ("command_line", "event_id", "host", "id", "process_name", "source", "timestamp", "timestamp_original", "user")


def export_lines(df: DataFrame, kind: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, value): a JSON object a row, keys in order. Times are ISO text."""
    types = dict(df.dtypes)
    record = F.struct(*[(iso(F.col(c)) if types[c] == "timestamp" else F.col(c)).alias(c) for c in sorted(columns)])
    line = F.to_json(F.struct(record.alias("record"), F.lit(kind).alias("record_type"), F.lit("evtrail.export/1").alias("schema"), F.lit("evtrail").alias("tool")), {"ignoreNullFields": "false"})
    key = "id" if "id" in df.columns else "event_id"
    return df.select(F.col(key).alias("id"), line.alias("value"))


def safe_csv(findings: DataFrame) -> DataFrame:
    """findings as text cells that no spreadsheet takes for a formula."""
    cell = lambda n, t: csv_safe(F.array_join(F.col(n).cast("array<string>"), ";") if t.startswith("array") else F.col(n).cast("string"))
    return findings.select(*[F.coalesce(cell(n, t), F.lit("")).alias(n) for n, t in findings.dtypes])
