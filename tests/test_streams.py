import json
import random

import pytest
from pyspark.sql import functions as F

from evtrail.operators import rules
from evtrail.session import CaseSession
from evtrail.sources import records
from evtrail.streaming import first_seen, intake, triage

from . import builders


def test_first_seen_as_the_rule_whatever_the_order(spark, tmp_path):
    r = random.Random(3)
    lines = []
    for i in range(240):
        at = f"2026-01-01T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00Z"
        lines.append(json.dumps({"id": i + 1, "timestamp": at, "timestamp_original": at if r.random() < 0.9 else None, "source": "evtx:Security", "event_id": r.choice(["4624", "4624", "4625"]), "user": r.choice(["CORP\\admin-1", "CORP\\admin-2", "root", "ann"]), "src_ip": r.choice([None, "", *[f"10.0.0.{k}" for k in range(9)]])}))
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda k: (folder / f"{k}.jsonl").write_text("\n".join(lines[40 * k : 40 * k + 40]))
    order = list(range(6))
    r.shuffle(order)
    # A later file shows that the second address was the first one.
    for k, at, address in ((order[0], "2025-06-01", "a"), (order[0], "2025-06-02", "b"), (order[5], "2025-05-01", "b")):
        lines[40 * k + (at > "2025-06-01")] = json.dumps({"id": 1000 + len(address + at) + k, "timestamp": f"{at}T00:00:00Z", "timestamp_original": at, "source": "evtx:Security", "event_id": "4624", "user": "CORP\\admin-1", "src_ip": address})
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        stream = records.parse_jsonl(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))).filter("error IS NULL").drop("error")
        first_seen.write(stream, table, checkpoint).awaitTermination()

    for k in order[:3]:
        put(k)
    go()
    for k in order[3:]:
        put(k)
    go()  # begins again from the checkpoint
    every = records.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).filter("error IS NULL")
    want = sorted((x["event_id"], x["detail"]) for x in rules.detect(every, ["EV-DET-ADMINHOST"]).collect())
    assert len(want) > 10
    assert sorted(map(tuple, first_seen.findings(spark, table).collect())) == want
    assert spark.read.parquet(table).filter("NOT present").count() > 0


def test_untimed_rows_go_round(spark):
    rows = [("a", None), ("b", "2026-01-01T00:00:00Z")]
    assert [x["user"] for x in triage.untimed(spark.createDataFrame(rows, "user string, timestamp_original string")).collect()] == ["a"]


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["registered", "noted", "appended", None])
def test_intake_over_a_crash(spark, tmp_path, step):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text(builders.SYSMON)
    session = CaseSession(spark, str(tmp_path / "store"), "case-1").create()
    go = lambda after=lambda _: None: intake.intake(session, str(folder), str(tmp_path / "cp"), after=after).awaitTermination()
    go()
    (folder / "b.json").write_text(builders.SECURITY)
    (folder / "c.xml").write_text(builders.SYSMON.replace("WS-1", "WS-2"))

    def kill(at):
        if at == step:
            raise Killed

    if step:
        with pytest.raises(Exception, match="Killed"):
            go(kill)
    if step == "noted":
        # Half of the events had been written when it was killed.
        noted = session.store.table("batches", "case-1").filter("batch = 1").first()
        half = session.all_events().filter("id = 1").withColumn("id", F.lit(noted["first_id"])).withColumn("case_id", F.lit("case-1"))
        session.store.append("events", half)
    go()
    go()
    rows = session.all_events().collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 7)) and len(rows) == 6
    assert session.store.table("evidence", "case-1").count() == 3
    if step != "noted":
        assert sorted((r["host"], r["event_id"]) for r in rows) == sorted([("WS-1", "1"), ("WS-1", "3"), ("WS-2", "1"), ("WS-2", "3"), ("WS-1", "4688"), ("WS-1", "4625")])
    assert session.store.next_id("events", "id", "case-1") == 7
