"""From a folder of evidence to events (survey A1, A2, A4, A17): hash, sniff, read each file by its kind; no bad file stops the others.

Files are read twice: once whole, for their hashes and kinds, and once for their records. Contents are never stored.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from . import artifacts, windows
from .artifacts import sniff
from .windows import LARGEST_FILE


def evidence(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, uri, size, sha256, md5, kind, form, root, bom, content) of each file; contents of files past the largest size are empty.

    form says how a file's records can be told apart without reading it whole, 'large' that it isn't parsed.
    """
    return facts_of(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path))


def facts_of(files: DataFrame) -> DataFrame:
    """evidence() of rows of Spark's binaryFile source, read at once or as a stream."""
    kind, small = sniff(F.col("content")), F.col("length") <= LARGEST_FILE
    return files.select(
        "path",
        F.col("_metadata.file_path").alias("uri"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
        kind.alias("kind"),
        F.when(~small, "large").otherwise(windows.form(F.col("content"), kind)).alias("form"),
        windows.root_tag(F.col("content")).alias("root"),
        (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"),
        F.when(small, F.col("content")).alias("content"),
    )


def _events(logs: DataFrame, rest: DataFrame, now: str, default_host: str | None) -> tuple[DataFrame, DataFrame]:
    events = windows.normalized(logs, now, default_host).unionByName(artifacts.normalized(rest, now, default_host))
    untimed = events.filter("timestamp IS NULL").select(F.col("provenance.source_file").alias("path"), F.lit("a record's time can't be read").alias("warning"))
    errors = [x.filter("error IS NOT NULL").select("path", F.col("error").alias("warning")) for x in (logs, rest)]
    return events.filter("timestamp IS NOT NULL"), untimed.unionByName(errors[0]).unionByName(errors[1])


def _whole(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log records, artifact rows) of files that are read whole: (path, sha256, kind, content)."""
    own = files.filter("content IS NOT NULL")
    return windows.records(own.filter("kind IN ('windows', 'evtx')")), artifacts.records(own.filter(F.col("kind").isin(*artifacts.READERS)))


def _odd(files: DataFrame, large: str) -> DataFrame:
    told = F.when(F.expr(large), "larger than what is parsed").when(F.col("kind").isNull(), "unknown kind of file")
    return files.select("path", told.alias("warning")).filter("warning IS NOT NULL")


def parse(files: DataFrame, ingest_time: str | None = None, default_host: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of files at hand, each read whole: (path, sha256, kind, content). kind overrides what sniffing says."""
    own = files if kind is None else files.withColumn("kind", F.lit(kind))
    events, warnings = _events(*map(written, _whole(own)), ingest_time or _now(), default_host)
    return events, _odd(own, "content IS NULL").unionByName(warnings)


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def scan(spark: SparkSession, facts: DataFrame, ingest_time: str | None = None, default_host: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of files on disk. facts: evidence() without contents, a written table; kind overrides what sniffing says.

    Exports are read a record at a time by all tasks, and their records written once; XML files that prove faulty so,
    and all other files, are read whole, by lists of paths.
    """
    own = facts if kind is None else facts.withColumn("kind", F.lit(kind)).withColumn("form", F.when(F.col("form") == "large", "large").when(F.lit(kind == "windows"), F.col("form")))
    parts, again = [], []
    for how in ("xml", "lines"):
        found = windows.pieces(spark, own, how)
        if found is not None:
            found = written(found)
            if how == "xml":
                bad = written(windows.faulty(found, own))
                again = [r["path"] for r in bad.collect()]
                found = found.join(bad, "path", "left_anti")
            parts.append(windows.in_order(found))
    rest = [r["path"] for r in own.filter("form IS NULL AND kind IS NOT NULL").select("path").collect()] + again
    if rest:
        contents = spark.read.format("binaryFile").load(windows.listed(rest)).select("path", "content")
        logs, others = _whole(contents.join(own.select("path", "sha256", "kind"), "path"))
    else:
        logs, others = _whole(spark.createDataFrame([], "path string, sha256 string, kind string, content binary"))
    logs = written(reduce(DataFrame.unionByName, [*parts, logs]))
    events, warnings = _events(logs, written(others), ingest_time or _now(), default_host)
    return events, _odd(own, "form = 'large'").unionByName(warnings)
