"""First-seen addresses of admin-like users as a stream (survey D9, 2.12): the rule's findings so far, whatever the order of files.

A user's state holds the first logon from each address. Events that come late may be earlier than what is known, and
then change which address was the user's first, and which were known before another; so each batch gives the findings
that it changed, and a finding that no longer is one comes with present = false. The last word on each (user, address)
is the rule's answer for all events so far. Rows without a time of their own are taken as the rule takes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import scalars as S

CHANGED = "user string, src_ip string, event_id long, timestamp timestamp, before array<string>, present boolean"
FIRST = ["user", "src_ip", "event_id", "timestamp", "before", "present"]


def findings_of(seen: dict[str, tuple[Any, int]]) -> dict[str, tuple[int, Any, list[str]]]:
    """{address: (event, time, addresses before)} of one user: all addresses but the first, in order of first logons."""
    order = sorted(seen, key=lambda a: seen[a])
    return {a: (seen[a][1], seen[a][0], sorted(order[:i])) for i, a in enumerate(order) if i}


class FirstSeen(StatefulProcessor):
    """State of a user: first time and event by address. ttl: milliseconds after which an address that isn't seen again is forgotten; 0 keeps all."""

    def __init__(self, ttl: int = 0) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "src_ip string", "us long, id long", self.ttl or None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        known = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        now = dict(known)
        for part in rows:
            for address, us, event in zip(part["src_ip"], part["us"], part["id"], strict=True):
                place = (int(us), int(event))
                now[address] = min(now.get(address, place), place)
        for address, place in now.items():
            if known.get(address) != place:
                self.seen.updateValue((address,), place)
        was, told = findings_of(known), findings_of(now)
        out = [(key[0], a, e, pd.Timestamp(us, unit="us"), before, True) for a, (e, us, before) in told.items() if was.get(a) != (e, us, before)]
        out += [(key[0], a, e, pd.Timestamp(us, unit="us"), [], False) for a, (e, us, _) in was.items() if a not in told]
        if out:
            yield pd.DataFrame(out, columns=FIRST)

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, ttl: int = 0) -> DataFrame:
    """Changed findings of a stream of events; keep the state with RocksDB (settings() below)."""
    address = S.blank(F.col("src_ip"))
    own = events.filter((F.col("source") == "evtx:Security") & (F.col("event_id") == "4624") & S.admin_like(F.coalesce("user", F.lit("?"))) & address.isNotNull())
    rows = own.select("user", address.alias("src_ip"), F.unix_micros("timestamp").alias("us"), F.coalesce("id", F.lit(0)).alias("id"))
    return rows.groupBy("user").transformWithStateInPandas(FirstSeen(ttl), CHANGED, "Update", "ProcessingTime" if ttl else "None")


def settings(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def write(events: DataFrame, table: str, checkpoint: str, ttl: int = 0) -> StreamingQuery:
    """Starts the stream over what is there: changes go to table/batch=N, which a batch that is run again overwrites."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    settings(events.sparkSession)
    return first_seen(events, ttl).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings(spark: SparkSession, table: str) -> DataFrame:
    """(event_id, detail) of all that a written table says last: the rows of the rule EV-DET-ADMINHOST."""
    every = spark.read.parquet(table)
    last = every.groupBy("user", "src_ip").agg(F.max_by(F.struct("event_id", "before", "present"), "batch").alias("r")).filter("r.present")
    return last.select(F.col("r.event_id").alias("event_id"), F.concat(F.col("user"), F.lit(" from "), F.col("src_ip"), F.lit(", before: "), F.array_join("r.before", ", ")).alias("detail"))
