"""The projected events written as the files they would come from, and read back: sniffing, dispatch, parsers (survey A3-A10, A14, A15, A17, K2, K8, K12)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import iso
from ..sources import binary, hives, ingest
from ..sources.artifacts import sniff
from ..tables import new_path, written
from .testdata import artifact_events, log_events

#: Events a file.
EACH = 100
CHANNELS = {"sysmon": "Microsoft-Windows-Sysmon/Operational", "security": "Security", "powershell": "Microsoft-Windows-PowerShell/Operational", "generic": "Application"}


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with the kind of export they go to, their time to a tenth of a microsecond, and their data fields."""
    e = log_events(spark, sf_dir)
    sysmon, of = F.col("source") == "sysmon", lambda *ids: F.col("event_id").isin(*ids)
    kind = F.when(sysmon & of("1") & (F.col("id") % 10 == 3), "powershell").when(sysmon, "sysmon").when(F.col("id") % 10 == 7, "generic").otherwise("security")
    e = e.withColumn("kind", kind)
    only = lambda k, c: F.when(F.col("kind") == k, c)
    number = lambda c: F.when(F.col("id") % 2 == 0, F.col(c).cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(c))))
    where = lambda c: F.concat(F.lit("C:\\Bin\\"), F.col(c))
    fields = {
        "User": only("sysmon", F.col("user")), "Image": only("sysmon", where("process_name")), "ParentImage": only("sysmon", where("parent_name")), "ProcessId": only("sysmon", number("process_id")),
        "ParentProcessId": only("sysmon", number("parent_id")), "CommandLine": only("sysmon", F.col("command_line")), "DestinationIp": only("sysmon", F.col("dst_ip")), "DestinationPort": only("sysmon", F.col("dst_port").cast("string")),
        "TargetFilename": only("sysmon", F.when(of("11"), F.col("file_path"))), "TargetObject": only("sysmon", F.col("registry_key")), "TargetDomainName": only("security", F.substring_index("user", "\\", 1)),
        "TargetUserName": only("security", F.substring_index("user", "\\", -1)), "IpAddress": only("security", F.col("src_ip")), "ScriptBlockText": only("powershell", F.col("command_line")),
    }
    channel = F.element_at(F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair]), F.col("kind"))
    time = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("id") % 10_000_000).cast("string"), 7, "0"), F.lit("Z"))
    event_id = F.when(F.col("kind") == "powershell", "4104").otherwise(F.col("event_id"))
    return e.select("id", event_id.alias("EventID"), channel.alias("Channel"), time.alias("TimeCreated"), F.col("host").alias("Computer"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("EventData"))


def _body(between: str) -> Column:
    return F.array_join(F.transform("a", lambda x: x["t"]), between)


def _on_disk(rows: DataFrame, text: Column, name: str, head: str, between: str, tail: str) -> DataFrame:
    """The events that are read back from files written to the shared folder, EACH events in order of id to a file."""
    spark = rows.sparkSession
    parts = rows.groupBy(F.floor(F.col("id") / EACH).alias("n")).agg(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))).alias("a"))
    folder = new_path(spark)
    parts.select("n", F.concat(F.lit(head), _body(between), F.lit(tail)).alias("value")).write.partitionBy("n").text(folder)
    facts = written(ingest.evidence(spark, folder).drop("content"))
    found, _ = ingest.scan(spark, facts, "2024-06-01T00:00:00Z")
    stem, _, ending = name.partition(".")
    file = F.concat(F.lit(f"{stem}-"), F.regexp_extract("provenance.source_file", r"/n=(\d+)/", 1), F.lit(f".{ending}"))
    return found.withColumns({"source_file": file, "record_index": F.col("provenance.record_index"), "ts": iso(F.col("timestamp"))})


def _files(rows: DataFrame, text: Column, name: str, head: str, between: str, tail: str) -> DataFrame:
    """EACH events in order of id to a file, as evidence() gives files."""
    number = F.floor(F.col("id") / EACH)
    parts = rows.groupBy(number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))).alias("a"))
    content = F.concat(F.lit(head), _body(between), F.lit(tail)).cast("binary")
    whole = parts.select(F.concat(F.lit(name.split(".")[0] + "-"), F.col("n").cast("string"), F.lit("." + name.split(".")[1])).alias("path"), content.alias("content"))
    return whole.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), sniff(F.col("content")).alias("kind"), "content")


def _event_xml() -> Column:
    tag = lambda name: F.concat(F.lit(f"<{name}>"), F.col(name), F.lit(f"</{name}>"))
    entries = F.map_entries(F.from_json(F.to_json("EventData"), "map<string,string>"))
    data = F.transform(entries, lambda x: F.concat(F.lit('<Data Name="'), x["key"], F.lit('">'), x["value"], F.lit("</Data>")))
    system = F.concat(tag("EventID"), F.lit('<TimeCreated SystemTime="'), F.col("TimeCreated"), F.lit('"/>'), tag("Channel"), tag("Computer"))
    return F.concat(F.lit("<Event><System>"), system, F.lit("</System><EventData>"), F.array_join(data, ""), F.lit("</EventData></Event>"))


def _read(files: DataFrame) -> DataFrame:
    found, _ = ingest.parse(files, "2024-06-01T00:00:00Z")
    return found.withColumns({"source_file": F.col("provenance.source_file"), "record_index": F.col("provenance.record_index"), "ts": iso(F.col("timestamp"))})


LOGGED = ("source_file", "record_index", "ts", "source", "event_id", "host", "user", "process_name", "parent_name", "command_line", "process_id", "parent_id", "src_ip", "dst_ip", "dst_port", "file_path", "registry_key")


def event_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_disk(_logged(spark, sf_dir), _event_xml(), "log.xml", "<Events>", "", "</Events>").select(*LOGGED)


def _json() -> Column:
    return F.to_json(F.struct("EventID", "Channel", "TimeCreated", "Computer", "EventData"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_disk(_logged(spark, sf_dir), _json(), "log.json", '{"Events": [', ",", "]}").select(*LOGGED)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object a line, of which Sysmon's have their own time alone."""
    own = F.col("Channel").contains("Sysmon")
    alone = F.struct("EventID", "Channel", "Computer", F.col("EventData").withField("UtcTime", F.translate(F.rtrim(F.col("TimeCreated"), F.lit("Z")), "T", " ")).alias("EventData"))
    return _on_disk(_logged(spark, sf_dir), F.when(own, F.to_json(alone)).otherwise(_json()), "log.jsonl", "", "\n", "").select(*LOGGED)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = artifact_events(spark, sf_dir).filter("source = 'services'")
    row = F.to_json(F.struct(F.col("process_name").alias("name"), F.concat(F.lit('"'), F.col("file_path"), F.lit('" -k run')).alias("image_path"), F.lit("LocalSystem").alias("account")))
    return _read(_files(own, row, "services.json", '{"services": [', ",", "]}")).select("source_file", "record_index", "source", "event_id", "user", "process_name", "command_line", "file_path")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a task, of which every third has no start but a date of registration."""
    own = artifact_events(spark, sf_dir).filter("source = 'tasks'").withColumn("id", F.col("id") * EACH)
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    third = F.col("id") % 3 == 0
    row = F.concat(
        F.lit("<RegistrationInfo>"), F.when(third, F.concat(F.lit("<Date>"), time, F.lit("</Date>"))).otherwise(""), F.lit("<URI>\\Job</URI></RegistrationInfo><Triggers>"),
        F.when(third, "").otherwise(F.concat(F.lit("<TimeTrigger><StartBoundary>"), time, F.lit("</StartBoundary></TimeTrigger>"))),
        F.lit("</Triggers><Principals><Principal><UserId>CORP\\svc</UserId></Principal></Principals><Actions><Exec><Command>"), F.col("file_path"), F.lit("</Command><Arguments>/q</Arguments></Exec></Actions>"),
    )
    files = _files(own, row, "task.xml", '<Task version="1.2" xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task">', "", "</Task>")
    return _read(files).select("source_file", "record_index", "ts", "source", "event_id", "user", "process_name", "command_line", "file_path")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each fault a warning tells of: binary logs, broken XML, unknown contents."""
    own = log_events(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.lit("ElfFile\0rest")).when(F.col("id") % 3 == 1, F.lit("<Events><Event></Events>")).otherwise(F.lit("\x01\x02 plain")).alias("t"))
    files = own.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.sha2("t", 256).alias("sha256"), F.md5("t").alias("md5"), sniff(F.col("t").cast("binary")).alias("kind"), F.col("t").cast("binary").alias("content"))
    _, told = ingest.parse(files, "2024-06-01T00:00:00Z")
    return told.groupBy(F.substring_index("warning", ":", 1).alias("fault")).agg(F.count("*").alias("files"))


def _hives(spark: SparkSession, sf_dir: str) -> str:
    """A folder of hives made of the suppliers, HIVE of them in each: a Run value and a key below Vendor for each."""
    folder = new_path(spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.floor(F.col("s_suppkey") / HIVE).alias("n")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey"))).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda t: (1, (t + "\0").encode("utf-16-le"))
        for b in batches:
            for r in b.to_pylist():
                values = {s["s_name"]: text(f"C:\\Temp\\{s['s_name']}.exe") for s in r["a"]}
                vendor = {f"S{s['s_suppkey']}": {"values": {"Tag": text(f"{s['s_name']}/{s['s_nationkey']}"), "Nation": (4, s["s_nationkey"].to_bytes(4, "little"))}} for s in r["a"]}
                tree: dict = {"Run": {"values": values}}
                for name in ("CurrentVersion", "Windows", "Microsoft"):
                    tree = {name: {"keys": tree}}
                store, at = hives.opened(f"{folder}/suppliers-{r['n']}.hiv")
                store.create_dir(at.rpartition("/")[0])
                # The same bytes under the same name, however often a task is run.
                with store.open_output_stream(at) as out:
                    out.write(binary.hive_of({"Software": {"keys": tree | {"Vendor": {"keys": vendor}}}}))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["files"])

    rows.mapInArrow(run, "files int").agg(F.sum("files")).collect()
    return folder


#: Suppliers of a hive.
HIVE = 50


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("n", F.regexp_extract("path", r"suppliers-(\d+)\.hiv", 1).cast("long"))


def registry_autoruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(hives.autoruns(spark, _hives(spark, sf_dir))).select("n", "key", "value", "data", "last_write")


def registry_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one key in every hive, by a path in another case."""
    return _numbered(hives.key_values(spark, _hives(spark, sf_dir), "SOFTWARE/Vendor/s7")).select("n", "key", "value", "kind", "data")


def registry_subkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(hives.subkeys(spark, _hives(spark, sf_dir), "Software\\Vendor")).select("n", "key")


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = hives.hives(spark, _hives(spark, sf_dir)).filter(F.col("lkey").startswith("software\\vendor\\")).filter("value IS NOT NULL")
    return _numbered(below).select("n", "key", "value", "kind", "data")
