import json

import pytest
from pyspark.sql import functions as F

from evtrail.operators import correlate, rules
from evtrail.report import narrative
from evtrail.schema import conform
from evtrail.sources import ingest, windows
from evtrail.tables import written


def record(i, channel="Microsoft-Windows-Sysmon/Operational", time='<TimeCreated SystemTime="2024-05-01T10:00:00Z"/>', text="x"):
    return f'<Event><System><EventID>1</EventID>{time}<Channel>{channel}</Channel><Computer>h</Computer></System><EventData><Data Name="Image">C:\\a\\p{i}.exe</Data><Data Name="CommandLine">{text}</Data></EventData></Event>'


FILES = {
    "plain.xml": "<?xml version='1.0'?>\n<!-- x --><Events>\n" + "\n".join(record(i) for i in range(40)) + "\n</Events>\n",
    "alone.xml": record(1),
    "bom.xml": b"\xef\xbb\xbf" + ("<Events>" + record(1, text="é中") + record(2) + "</Events>").encode(),
    "prefix.xml": "<Events xmlns:q='urn:q' xmlns='urn:e'>" + record(1).replace("<Event>", "<Event q:a='1'>") + "</Events>",
    "quoted.xml": "<Events>" + record(1, text="<![CDATA[ </Event> ]]>") + record(2) + "</Events>",
    "empty-one.xml": "<Events>" + record(1) + "<Event/>" + record(2) + "</Events>",
    "cut.xml": "<Events>" + record(1, "Security") + record(2, "Security")[:-8],
    "cut-sysmon.xml": "<Events>" + record(1) + record(2)[:-8],
    "open.xml": "<Events>" + record(1, "Security"),
    "after.xml": "<Events>" + record(1, "Security") + "</Events>" + record(2, "Security"),
    "words.xml": "<Events>" + record(1, "Security") + " words & more " + record(2, "Security") + "</Events>",
    "bad.xml": "<Events>" + record(1, "Security") + record(2, "Security").replace("<System>", "<System><a>") + "</Events>",
    "wide.xml": ("<Events>" + record(1) + "</Events>").encode("utf-16"),
    "latin.xml": "<?xml version='1.0' encoding='iso-8859-1'?><Events>".encode() + record(1, text="é").encode("latin-1") + b"</Events>",
    "own-time.xml": "<Events>" + record(1, time="").replace("<EventData>", '<EventData><Data Name="UtcTime">2024-05-01 10:00:00.123</Data>') + "</Events>",
    "array [1].json": json.dumps([{"EventID": 1, "TimeCreated": "2024-05-01T10:00:00Z"}, {"EventID": 2}, 3]),
    "lines.json": "\n".join(json.dumps({"EventID": i, "Channel": "Sysmon", "EventData": {"UtcTime": "2024-05-01 10:00:0%d.5" % (i % 10), "Image": f"p{i}"}}) for i in range(30)) + "\nnot json\n\n" + json.dumps({"EventID": 99}) + "\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("exports")
    for name, body in FILES.items():
        (top / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return top


def rows(frame):
    return sorted(((r["path"].rsplit("/", 1)[1], r["record_index"], r["event_id"], r["time"], tuple(sorted((r["data"] or {}).items()))) for r in frame.filter("error IS NULL").collect()), key=str)


def test_cut_files_read_as_whole_ones(spark, folder):
    """By pieces of a few hundred bytes, several tasks a file, as by one parser for the whole file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = ingest.evidence(spark, str(folder))
        facts = written(files.drop("content"))
        whole, warned = ingest.parse(files, "2024-06-01T00:00:00Z")
        cut, told = ingest.scan(spark, facts, "2024-06-01T00:00:00Z")
        flat = lambda e: sorted((str(r.asDict(recursive=True)) for r in e.collect()))
        assert flat(cut) == flat(whole) and cut.count() > 70
        assert sorted(map(tuple, told.collect())) == sorted(map(tuple, warned.collect()))
        forms = {r["path"].rsplit("/", 1)[1]: r["form"] for r in facts.collect()}
        assert (forms["plain.xml"], forms["lines.json"], forms["wide.xml"], forms["array%20[1].json" if "array%20[1].json" in forms else "array [1].json"]) == ("xml", "lines", None, None)
        found = windows.pieces(spark, facts, "xml")
        assert found.filter(F.col("path").endswith("/plain.xml")).select("block").distinct().count() > 5
        bad = {r["path"].rsplit("/", 1)[1] for r in windows.faulty(written(found), facts).collect()}
        assert bad == {"quoted.xml", "cut.xml", "cut-sysmon.xml", "open.xml", "after.xml", "words.xml", "bad.xml"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sysmon_records_have_a_time_of_their_own(spark, folder):
    events, _ = ingest.scan(spark, written(ingest.evidence(spark, str(folder)).drop("content")))
    own = {r["provenance"]["source_file"].rsplit("/", 1)[1]: r for r in events.filter("timestamp_original LIKE '2024-05-01 10%'").collect()}
    assert set(own) == {"own-time.xml", "lines.json"}
    assert str(own["own-time.xml"]["timestamp"]) == "2024-05-01 10:00:00"
    assert own["own-time.xml"]["timestamp_original"] == "2024-05-01 10:00:00.123"


def test_a_large_export_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.xml", "w") as out:
        out.write("<Events>")
        for i in range(60_000):
            out.write(record(i, text="y" * 900))
        out.write("</Events>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        facts = written(ingest.evidence(spark, str(tmp_path)).drop("content"))
        found = windows.pieces(spark, facts, "xml")
        assert found.rdd.getNumPartitions() >= 7
        events, warnings = ingest.scan(spark, facts)
        told = events.agg(F.count("*"), F.count_distinct("provenance.record_index"), F.max("provenance.record_index"), F.count_if(F.col("process_name") != F.concat(F.lit("p"), F.col("provenance.record_index").cast("string"), F.lit(".exe")))).first()
        assert tuple(told) == (60_000, 60_000, 59_999, 0) and warnings.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def made(spark, values):
    base = {"timestamp": "2024-01-01T10:00:00Z", "timestamp_original": "x", "source": "sysmon", "host": "h1"}
    keys = sorted({k for v in values for k in v} | set(base))
    frame = spark.createDataFrame([tuple(str((base | v).get(k)) if (base | v).get(k) is not None else None for k in keys) for v in values], ", ".join(f"{k} string" for k in keys))
    return conform(frame.withColumn("timestamp", F.to_timestamp("timestamp")))


def test_download_is_sought_in_command_lines_not_in_other_fields(spark):
    e = made(spark, [
        {"id": 1, "event_id": "1", "process_name": "powershell.exe", "command_line": "powershell -file a.ps1", "raw": "ParentCommandLine=IWR http://x"},
        {"id": 2, "event_id": "1", "process_name": "powershell.exe", "command_line": "powershell IWR http://x"},
        {"id": 3, "event_id": "4104", "source": "powershell", "command_line": "cut off", "raw": "cut off; IWR http://x"},
    ])
    assert sorted(r["event_id"] for r in rules.detect(e, ["EV-DET-DLPSH"]).collect()) == [2, 3]


def test_a_cluster_asks_the_whole_case_what_is_missing(spark):
    cluster = [
        {"id": 1, "event_id": "11", "file_path": "C:\\t\\run.exe", "process_name": "a.exe"},
        {"id": 2, "event_id": "11", "file_path": "C:\\t\\left.exe", "process_name": "a.exe"},
        {"id": 3, "event_id": "1", "process_name": "a.exe"},
        {"id": 4, "event_id": "1", "process_name": "b.exe"},
        {"id": 5, "event_id": "run-key", "source": "registry", "file_path": "C:\\t\\run.exe"},
        {"id": 6, "event_id": "run-key", "source": "registry", "file_path": "C:\\t\\never.exe"},
        {"id": 7, "event_id": "3", "dst_ip": "8.8.8.8", "dst_port": 1, "timestamp": "2024-01-01T12:00:00Z"},
        {"id": 8, "event_id": "3", "dst_ip": "8.8.4.4", "dst_port": 2, "timestamp": "2024-01-01T14:00:00Z"},
    ]
    others = [
        {"id": 20, "event_id": "1", "process_name": "run.exe", "host": "h2"},
        {"id": 21, "event_id": "prefetch", "source": "prefetch", "process_name": "A.EXE", "host": "h2"},
        {"id": 22, "event_id": "1", "process_name": "c.exe", "timestamp": "2024-01-01T12:10:00Z"},
        {"id": 23, "event_id": "1", "process_name": "c.exe", "timestamp": "2024-01-01T14:10:00Z", "host": "h3"},
    ]
    every = written(made(spark, cluster + others))
    own = every.filter("id < 20")
    ask = lambda f: sorted(r[-1] for r in f(own, every).collect())
    assert ask(correlate.missing_file) == ["C:\\t\\left.exe"]
    assert ask(correlate.missing_prefetch) == ["b.exe"]
    assert ask(correlate.missing_persist) == ["C:\\t\\never.exe"]
    assert ask(correlate.missing_network) == ["8.8.4.4:2"]
    members = own.select("id", F.lit(1).cast("long").alias("root"))
    told = narrative(every, rules.explained(rules.numbered(rules.detect(every)), every), members, 1)
    assert told["missing"] == {"prefetch": ["b.exe"], "persist": ["C:\\t\\never.exe"], "network": ["8.8.4.4:2"], "file": ["C:\\t\\left.exe"]}


def test_hives_as_a_source(spark, tmp_path, monkeypatch):
    from evtrail.sources import binary, hives

    text = lambda t: (1, (t + "\0").encode("utf-16-le"))
    wide = {f"K{i}": {"values": {"v": text(str(i)), "n": (4, i.to_bytes(4, "little"))}, "keys": {"Below": {}}} for i in range(300)}
    tree = {"Software": {"keys": {"Run": {"values": {"a": text("C:\\a.exe"), "list": (7, "x\0y\0\0".encode("utf-16-le"))}}, "Many": {"keys": wide}}}}
    for i in range(5):
        (tmp_path / f"h{i}").write_bytes(binary.hive_of(tree))
    (tmp_path / "no").write_bytes(b"not a hive")
    every = hives.hives(spark, str(tmp_path))
    assert every.filter("fault IS NOT NULL").count() == 1
    assert every.filter("value IS NOT NULL").count() == 5 * 602
    assert every.filter("lkey LIKE '%below' AND value IS NULL").count() == 5 * 300
    own = hives.key_values(spark, str(tmp_path), "software/MANY/k7").collect()
    assert len(own) == 10 and {(r["key"], r["value"], r["data"]) for r in own} == {("Software\\Many\\K7", "v", "7"), ("Software\\Many\\K7", "n", "7")}
    assert hives.subkeys(spark, str(tmp_path / "h0"), "Software\\Many").count() == 300
    assert {r["data"] for r in every.filter("lkey = 'software\\\\run' AND value = 'list'").collect()} == {"x\ny"}
    # A pushed path leads to its own cells.
    reader = hives.HiveReader(str(tmp_path / "h0"))
    assert list(reader.pushFilters([hives.EqualTo(("lkey",), "software\\run")])) == [hives.EqualTo(("lkey",), "software\\run")]
    hive = binary.Hive((tmp_path / "h0").read_bytes())
    assert len(list(reader.rows_of(hive, "h0"))) == 2
    few = hive.cells
    list(hives.HiveReader("").rows_of(whole := binary.Hive((tmp_path / "h0").read_bytes()), "h0"))
    assert few < 15 and whole.cells > 1500
    assert [len(p.paths) for p in hives.packed([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10)] == [2, 1, 1]
    plan = hives.key_values(spark, str(tmp_path), "software/run")
    assert plan.count() == 10
