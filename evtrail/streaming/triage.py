"""Streams of JSONL events: an addition, as the engine's own commands are all batch. Untimed rows go round the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import timed
from ..operators.rules import BURST, BURST_SECONDS
from ..sources.records import parse_jsonl


def jsonl_stream(spark: SparkSession, path: str) -> DataFrame:
    """Usable events of new files in a folder; with availableNow and a checkpoint each file is read once."""
    return parse_jsonl(spark.readStream.text(path)).filter("error IS NULL").drop("error")


def bursts(events: DataFrame, late: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """Windows of failed logons that reach the burst rule's number, by user and address, as windows close."""
    own = events.filter(timed() & (F.col("source") == "evtx:Security") & (F.col("event_id") == "4625")).withWatermark("timestamp", late)
    return own.groupBy(F.window("timestamp", f"{BURST_SECONDS} seconds", slide), "user", "src_ip").agg(F.count("*").alias("n")).filter(F.col("n") >= BURST)


def untimed(events: DataFrame) -> DataFrame:
    return events.filter(~timed())
