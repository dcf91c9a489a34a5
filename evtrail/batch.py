"""Batch triage: a case for each file of a folder, all in one plan, resumable by a manifest (survey B8, H11, Q29, Q30)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import attack, rules
from .schema import SEVERITIES, severity_rank
from .session import EVENT_ORDER, STORED
from .sources import ingest
from .store import SCHEMA_VERSION, Store, now
from .tables import written

#: What one run takes.
MOST_FILES, MOST_BYTES = 10_000, 10 * 1024**3
MANIFEST = "sha256 string, file string, case_id string, events long, findings long, " + ", ".join(f"{s} long" for s in SEVERITIES)
CASE = ("case_id",)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of files below folder, but for those in hidden folders of it, with the case of each; a written table."""
    facts = written(ingest.evidence(spark, folder).drop("content"))
    top = facts.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inside = F.substring_index(F.col("path"), f"{top}/", -1)
    own = facts.filter(~F.concat(F.lit("/"), inside).contains("/."))
    sizes = own.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if sizes["n"] > MOST_FILES or (sizes["bytes"] or 0) > MOST_BYTES:
        raise ValueError("more than one batch takes")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "-")
    stem = F.substring(F.regexp_replace(stem, r"^[-._]+|[-._]+$", ""), 1, 40)
    case = F.concat(F.when(stem == "", "case").otherwise(stem), F.lit("-"), F.substring("sha256", 1, 12))
    # Of files alike in content one is a case.
    one = own.withColumn("file", name).withColumn("case_id", case).groupBy("sha256").agg(F.min_by(F.struct("*"), "path").alias("f"))
    return one.select("f.*")


def counted(events: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, events, findings, and each severity's number) of several cases at once; a case without events isn't there."""
    per = findings.groupBy(*CASE).agg(F.count("*").alias("findings"), *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return events.groupBy(*CASE).agg(F.count("*").alias("events")).join(per, "case_id", "left").select("case_id", "events", *map(zero, ("findings", *SEVERITIES)))


def triaged(spark: SparkSession, fresh: DataFrame, store: Store, severity: str) -> DataFrame:
    """Reads the files of fresh (files_of() rows), searches each as a case of its own, stores all; gives the findings that count.

    A case is one file, of bounded size, so its rows can be numbered in one window. The manifest is written last, and
    a case takes the place of what a run that was cut off has left of it.
    """
    at = now()
    store.replace("cases", fresh.select("case_id", F.col("case_id").alias("name"), F.lit(at).alias("created"), F.lit(SCHEMA_VERSION).alias("schema_version")))
    store.replace("evidence", fresh.select("case_id", F.lit(1).cast("long").alias("evidence_id"), "path", "size", "sha256", "md5", "kind"))
    events, _ = ingest.scan(spark, fresh)
    held = events.drop("id", "evidence_id").join(fresh.select("case_id", F.col("sha256").alias("_s")), F.col("provenance.source_sha256") == F.col("_s")).drop("_s")
    number = F.row_number().over(Window.partitionBy("case_id").orderBy(*EVENT_ORDER)).cast("long")
    own = written(held.withColumn("id", number).withColumn("evidence_id", F.lit(1).cast("long")))
    store.replace("events", own)
    found = written(rules.detect(own, by=CASE))
    order = Window.partitionBy("case_id").orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "event_id", "detail")
    told = rules.explained(found.withColumn("uid", F.format_string("EV-%04d", F.row_number().over(order))), own, by=CASE)
    store.replace("findings", told.select(*STORED))
    counts = found.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(severity))
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("events", "findings", *SEVERITIES)]
    rows = fresh.join(counted(own, counts), "case_id", "left").select("sha256", "file", "case_id", *none)
    rows.write.mode("append").parquet(f"{store.folder}/manifest")
    return counts


def run(spark: SparkSession, folder: str, out: str, severity: str = "informational") -> dict[str, object]:
    """Summary of all files, in out/summary.json. Files that the manifest knows by content aren't parsed again; top techniques are of this run's files."""
    store = Store(spark, f"{out}/store")
    done = lambda: spark.read.schema(MANIFEST).parquet(f"{store.folder}/manifest") if store.exists("manifest") else spark.createDataFrame([], MANIFEST)
    every = files_of(spark, folder)
    fresh = written(every.join(done().select("sha256"), "sha256", "left_anti"))
    n, new = every.count(), fresh.count()
    top = [r.asDict() for r in attack.top_techniques(triaged(spark, fresh, store, severity)).collect()] if new else []
    total = done().agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", *SEVERITIES)]).first()
    summary = {"files": total["files"], "skipped": n - new, "events": total["events"], "by_severity": {s: total[s] for s in SEVERITIES}, "top_techniques": top}
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "summary.json").write_text(json.dumps(summary, indent=2, sort_keys=True))
    return summary
