import json
import time

import pytest

from evtrail import batch, cli
from evtrail.session import CaseSession
from evtrail.sources import binary, records
from evtrail.store import Store
from evtrail.streaming import triage

from . import builders


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("evidence")
    for name, body in {"sysmon.xml": builders.SYSMON, "security.json": builders.SECURITY, "task.xml": builders.TASK, "services.json": builders.SERVICES, "bad.xml": "<Event><System>", "note.txt": "hello"}.items():
        (top / name).write_text(body)
    (top / "EVIL.pf").write_bytes(builders.prefetch())
    (top / "SOFTWARE").write_bytes(builders.software())
    (top / "log.evtx").write_bytes(b"ElfFile\0" + bytes(100))
    return top


@pytest.fixture(scope="module")
def session(spark, folder, tmp_path_factory):
    s = CaseSession(spark, str(tmp_path_factory.mktemp("store")), "case-1").create("first")
    s.summary = s.ingest(str(folder))
    return s


def test_ingest_reads_all_kinds(session):
    rows = {(r["source"], r["event_id"]): r for r in session.all_events().collect()}
    assert set(rows) == {("sysmon", "1"), ("sysmon", "3"), ("evtx:Security", "4688"), ("evtx:Security", "4625"), ("tasks", "task"), ("services", "service"), ("prefetch", "prefetch"), ("registry", "run-key")}
    ps = rows["sysmon", "1"]
    assert (ps["process_name"], ps["process_id"], ps["parent_name"], ps["hashes"], ps["flags"]) == ("powershell.exe", 4242, "WINWORD.EXE", {"md5": "AB", "sha256": "CD"}, ["encoded-command"])
    made = rows["evtx:Security", "4688"]
    assert (made["process_id"], made["parent_id"], made["user"]) == (500, 16, "CORP\\bob")
    assert (rows["evtx:Security", "4625"]["user"], rows["evtx:Security", "4625"]["src_ip"]) == ("eve", "10.0.0.9")
    task = rows["tasks", "task"]
    assert (task["file_path"], sorted(task["flags"])) == ("C:\\Temp\\evil.exe", ["action-in-temp-dir", "runs-as-system"])
    assert rows["prefetch", "prefetch"]["process_name"] == "EVIL.EXE" and "run_count=3" in rows["prefetch", "prefetch"]["raw"]
    assert rows["registry", "run-key"]["file_path"] == "C:\\Temp\\evil.exe"
    assert all(r["provenance"]["source_sha256"] and r["evidence_id"] for r in rows.values())
    services = [r for r in session.all_events().collect() if r["source"] == "services"]
    assert {r["timestamp_original"] is None for r in services} == {True, False}  # the export has no times, the hive has
    assert session.summary["registered"] == 9
    assert len(session.summary["warnings"]) == 5  # bad XML, binary log, unknown file, record without time, service without name


def test_ingest_again_registers_nothing_new(session, folder):
    before = session.all_events().count()
    session.ingest(str(folder), dedupe=True)
    assert session.all_events().count() == before
    assert session.store.table("evidence", "case-1").count() == 9


def test_session_end_to_end(session, tmp_path, spark):
    found = session.detect()
    assert {"EV-DET-ENCPSH", "EV-DET-OFFICE", "EV-DET-RAREPORT", "EV-DET-TASK", "EV-DET-RUNKEY", "EV-DET-SVC", "EV-DET-TEMPEXEC"} <= {r["rule_id"] for r in found.collect()}
    assert session.detect(severity="high+", save=False).filter("severity NOT IN ('high', 'critical')").count() == 0
    session.add_note("look here", "ann")
    assert session.notes().first()["text"] == "look here"
    paths = session.report(str(tmp_path / "out"), ("all",))
    built = json.loads(open(paths[0]).read())
    from evtrail.report import SECTIONS

    assert set(built) == set(SECTIONS)
    page = open([p for p in paths if p.endswith("html")][0]).read()
    assert "http" not in page and "<script" not in page
    session.export("events", str(tmp_path / "lines"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == session.all_events().count() and {x["record_type"] for x in lines} == {"event"}
    assert session.narrative(0)["observed"]
    assert session.sigma().count() >= 3
    assert session.audit().first()["command"] == "ingest"
    row = session.store.cases().first()
    assert row["events"] == session.all_events().count()
    with pytest.raises(ValueError):
        session.create()


def test_cli(session, spark, capsys, folder):
    base = ["--state-dir", session.store.folder, "--case", "case-1"]
    assert cli.main([*base, "events", "--host", "ws-1", "--limit", "2"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["result"]) == 2
    assert cli.main([*base, "registry", str(folder / "SOFTWARE"), "Software\\Microsoft\\Windows\\CurrentVersion\\Run"], spark) == 0
    assert json.loads(capsys.readouterr().out)["result"]["values"][0][0] == "Upd"
    assert cli.main([*base, "registry", str(folder / "SOFTWARE"), "Nope"], spark) == 2
    assert cli.main([*base, "create"], spark) == 2


def test_batch_resumes(spark, folder, tmp_path):
    small = tmp_path / "in"
    small.mkdir()
    (small / "a.xml").write_text(builders.SYSMON)
    (small / ".hidden").mkdir()
    (small / ".hidden" / "b.xml").write_text(builders.SYSMON)
    first = batch.run(spark, str(small), str(tmp_path / "out"))
    assert (first["files"], first["skipped"], first["events"]) == (1, 0, 2) and first["by_severity"]["high"] >= 1
    (tmp_path / "in" / "c.json").write_text(builders.SECURITY)
    second = batch.run(spark, str(small), str(tmp_path / "out"))
    assert (second["files"], second["skipped"], second["events"]) == (2, 1, 4)


def test_batch_is_as_a_case_for_each_file(spark, folder, tmp_path):
    """All files in one plan: the same events and findings as one session a file; again, nothing is parsed."""
    began = time.monotonic()
    told = batch.run(spark, str(folder), str(tmp_path / "out"))
    took = time.monotonic() - began
    store = Store(spark, str(tmp_path / "out" / "store"))
    manifest = {r["file"]: r for r in store.spark.read.parquet(f"{store.folder}/manifest").collect()}
    assert set(manifest) == {p.name for p in folder.iterdir()} and told["files"] == 9 and told["skipped"] == 0
    for name in ("sysmon.xml", "security.json", "SOFTWARE", "task.xml"):
        one = CaseSession(spark, str(tmp_path / name), "one").create()
        one.ingest(str(folder / name))
        case = manifest[name]["case_id"]
        flat = lambda e: sorted(str({k: v for k, v in r.asDict(recursive=True).items() if k not in ("case_id", "provenance")}) for r in e.collect())
        assert flat(store.table("events", case)) == flat(one.all_events())
        assert flat(store.table("findings", case)) == flat(one.detect())
        assert manifest[name]["findings"] == store.table("findings", case).count()
    again = batch.run(spark, str(folder), str(tmp_path / "out"))
    assert (again["files"], again["skipped"], again["events"], again["by_severity"]) == (9, 9, told["events"], told["by_severity"])
    print(f"batch of 9 files: {took:.1f} s")


def test_binary_bounds():
    for bad in (b"", b"MAM\x04" + bytes(90), builders.prefetch()[:200], b"\x1e\0\0\0SCCA" + b"\xff" * 300):
        with pytest.raises(binary.Malformed):
            binary.prefetch(bad)
    for bad in (b"", b"regf" + bytes(5000), builders.software()[:4200]):
        with pytest.raises(binary.Malformed):
            binary.list_key(bad, "Software\\Microsoft\\Windows\\CurrentVersion\\Run")
    got = binary.prefetch(builders.prefetch(runs=7))
    assert (got["executable"], got["runs"], len(got["last_runs"]), got["files"]) == ("EVIL.EXE", 7, 1, ["\\DEVICE\\C\\TEMP\\EVIL.EXE"])


def test_jsonl_and_stream(spark, tmp_path):
    good = {"timestamp": "2026-01-01T00:00:00Z", "timestamp_original": "2026-01-01T00:00:00Z", "source": "evtx:Security", "event_id": 4625, "user": "eve", "src_ip": "1.2.3.4", "process_id": 7}
    lines = [json.dumps(good | {"timestamp": f"2026-01-01T00:00:{i:02d}Z"}) for i in range(6)] + ["", "{bad", "[1]", json.dumps(good | {"process_id": "x"}), json.dumps(good | {"source": ""}), json.dumps(good | {"timestamp": "later"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    events, rejected = records.load_jsonl(spark, str(tmp_path / "in"))
    assert (events.count(), rejected.count()) == (6, 5)
    q = triage.bursts(triage.jsonl_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bursts").filter("n = 6").count() > 0
