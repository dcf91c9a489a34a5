"""The case store: Parquet tables partitioned by case (survey B1-B4, B9, H12)."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT

#: Fixed value: what a case may be called.
CASE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
#: 1: findings of six columns; 2: explained findings, of which older ones lack the last three columns.
SCHEMA_VERSION = 2
TABLES = {
    "cases": "case_id string, name string, created string, schema_version int",
    "evidence": "case_id string, evidence_id long, path string, size long, sha256 string, md5 string, kind string",
    "findings": "case_id string, uid string, rule_id string, severity string, confidence int, event_id long, detail string, evidence array<long>, title string, why array<string>, what string, observed array<string>, inferred array<string>, confidence_reason string, mitre array<string>, provenance string, rule_version string, limitations array<string>, evidence_refs array<struct<event_id:bigint,source:string,source_event_id:string,observation:string>>",
    "notes": "case_id string, at string, author string, text string",
    "batches": "case_id string, stream string, batch long, first_id long, events long",
    "coverage_parts": "case_id string, part string, source string, events long, first timestamp, last timestamp",
    "entity_parts": "case_id string, part string, type string, value string, observed array<string>, events long, sources array<string>, first timestamp, last timestamp",
    "parts": "case_id string, part string, upto long, merged array<string>",
    "labels": "case_id string, part string, id long, root long",
    "hubs": "case_id string, part string, kind string, h string, key string, id long",
    "growths": "case_id string, part string, upto long",
    "audit": "case_id string, at string, command string, arguments string",
}


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def table(self, table: str, case_id: str | None = None) -> DataFrame:
        """A table's rows; columns that older files lack are null."""
        if table == "events":
            schema = "case_id string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT)
        else:
            schema = TABLES[table]
        df = self.spark.read.schema(schema).parquet(self._path(table)) if self.exists(table) else self.spark.createDataFrame([], schema)
        return df if case_id is None else df.filter(F.col("case_id") == case_id)

    def append(self, table: str, df: DataFrame, *below: str) -> None:
        """Adds rows, in a folder for each case, and for each value of below."""
        df.write.mode("append").partitionBy("case_id", *below).parquet(self._path(table))

    def add(self, table: str, rows: list[tuple]) -> None:
        self.append(table, self.spark.createDataFrame(rows, TABLES[table]).coalesce(1))

    def create_case(self, case_id: str, name: str = "") -> None:
        if not CASE_ID.fullmatch(case_id):
            raise ValueError(f"not a case id: {case_id!r}")
        if self.table("cases", case_id).head(1):
            raise ValueError(f"the case {case_id} exists")
        self.add("cases", [(case_id, name or case_id, now(), SCHEMA_VERSION)])

    def replace(self, table: str, df: DataFrame) -> None:
        """Puts df in the place of the rows of its cases; df must not read the table."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(self._path(table))

    def version(self, case_id: str) -> int | None:
        """The layout that a case was written in, null if there is no such case; one that is newer than this engine is an error."""
        found = self.table("cases", case_id).agg(F.max(F.coalesce("schema_version", F.lit(1)))).first()[0]
        if found is not None and found > SCHEMA_VERSION:
            raise ValueError(f"the case {case_id} has layout {found}, this engine knows {SCHEMA_VERSION}")
        return found

    def cases(self) -> DataFrame:
        """Cases with their numbers of events, pieces of evidence and findings."""
        out = self.table("cases")
        for table in ("events", "evidence", "findings"):
            out = out.join(self.table(table).groupBy("case_id").agg(F.count("*").alias(table)), "case_id", "left").fillna(0, [table])
        return out

    def next_id(self, table: str, column: str, case_id: str) -> int:
        """The number after all that are in the table, or that a batch of a stream has been promised."""
        used = self.table(table, case_id).agg(F.max(column)).first()[0] or 0
        if table == "events":
            used = max(used, self.table("batches", case_id).agg(F.max(F.col("first_id") + F.col("events") - 1)).first()[0] or 0)
        return used + 1

    def settled(self, case_id: str) -> int:
        """The last event id up to which nothing can be added: before the first batch of a stream that was noted and isn't there whole."""
        last = self.next_id("events", "id", case_id) - 1
        batches = self.table("batches", case_id).select("first_id", "events")
        held = self.table("events", case_id).select("id").join(F.broadcast(batches), F.col("id").between(F.col("first_id"), F.col("first_id") + F.col("events") - 1))
        there = held.groupBy("first_id").agg(F.count("*").alias("held"))
        short = batches.join(there, "first_id", "left").filter(F.coalesce("held", F.lit(0)) < F.col("events")).agg(F.min("first_id")).first()[0]
        return last if short is None else min(last, short - 1)
