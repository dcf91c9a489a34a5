"""Windows event records from XML and JSON exports (survey A5-A10, K10, K12).

UTF-8 exports whose records end in </Event>, and files of a JSON object a line, are cut into records by Spark's text
reader, so that one file is read by as many tasks as it has blocks, and a task holds one record at a time. A file that
is found faulty that way, and any other form (UTF-16, prefixed tags, one JSON array), is read whole by one task.
Records become one struct (id, channel, time, computer, user, data map), and one native projection for each
channel turns those into normalized events.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import conform

#: Fixed value: larger files are registered, not parsed.
LARGEST_FILE = 100 * 1024 * 1024
RECORD = "path string, sha256 string, kind string, record_index int, event_id string, channel string, time string, computer string, user_id string, data map<string,string>, error string"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_record(event: ET.Element) -> dict[str, Any]:
    """One <Event>, whatever its namespace; unnamed data are data_0, data_1, ..."""
    out: dict[str, Any] = {"event_id": "0", "channel": None, "time": None, "computer": None, "user_id": None, "data": {}}
    for part in event:
        if _name(part.tag) == "System":
            for x in part:
                name, text = _name(x.tag), (x.text or "").strip() or None
                if name == "EventID":
                    out["event_id"] = text or "0"
                elif name == "TimeCreated":
                    out["time"] = x.get("SystemTime")
                elif name == "Channel":
                    out["channel"] = text
                elif name == "Computer":
                    out["computer"] = text
                elif name == "Security":
                    out["user_id"] = x.get("UserID")
        elif _name(part.tag) in ("EventData", "UserData"):
            for i, x in enumerate(part):
                out["data"][x.get("Name") or (_name(x.tag) if _name(x.tag) != "Data" else f"data_{i}")] = (x.text or "").strip()
    return out


def xml_records(content: bytes, streamed: bool) -> Iterator[dict[str, Any]]:
    """Records of an export. A fault drops the whole file, or, if streamed, only what comes after it."""
    found: list[dict[str, Any]] = []
    try:
        for _, element in ET.iterparse(io.BytesIO(content), events=("end",)):
            if _name(element.tag) == "Event":
                found.append(xml_record(element))
                element.clear()
    except ET.ParseError as fault:
        if streamed:
            yield from found
        yield {"error": f"malformed XML: {fault}"}
        return
    yield from found


def json_record(r: Any) -> dict[str, Any]:
    """One record of a JSON export."""
    if not isinstance(r, dict):
        return {"error": "a record isn't an object"}
    data = r.get("EventData") or {}
    time = r.get("TimeCreated") or r.get("SystemTime")
    if not time and kind_of(r.get("Channel")) == "sysmon" and isinstance(data, dict):
        time = data.get("UtcTime")
    if not time:
        return {"error": "a record has no time"}
    text_of = lambda k: None if r.get(k) is None else str(r[k])
    return {"event_id": text_of("EventID") or "0", "channel": text_of("Channel"), "time": str(time), "computer": text_of("Computer"), "user_id": text_of("UserID"), "data": {str(k): "" if v is None else str(v) for k, v in data.items()} if isinstance(data, dict) else {}}


def json_line(line: str) -> list[dict[str, Any]]:
    if not line.strip():
        return []
    try:
        return [json_record(json.loads(line))]
    except ValueError:
        return [{"error": "a line isn't JSON"}]


def json_records(content: bytes) -> Iterator[dict[str, Any]]:
    """An array, {"Events": [...]} or a JSON object a line."""
    text = content.decode("utf-8-sig", "replace")
    try:
        whole = json.loads(text)
    except ValueError:
        for line in text.splitlines():
            yield from json_line(line)
        return
    rows = whole.get("Events", [whole]) if isinstance(whole, dict) else whole
    yield from map(json_record, rows if isinstance(rows, list) else [])


KINDS = ("sysmon", "security", "powershell", "generic")


def kind_of(channel: str | None) -> str:
    low = (channel or "").lower()
    return "sysmon" if "sysmon" in low else "powershell" if "powershell" in low else "security" if low == "security" else "generic"


#: Records that a task holds before it hands them on.
HELD = 10_000


def _rows(found: Iterator[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of HELD rows."""
    rows = []
    for row in found:
        rows.append({n: row.get(n) for n in _SCHEMA.names})
        if len(rows) == HELD:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _usable(r: dict[str, Any]) -> dict[str, Any]:
    return r if r.get("error") else r | {"kind": kind_of(r["channel"]), "data": list(r["data"].items())}


def records(files: DataFrame) -> DataFrame:
    """files: (path, sha256, content), of event exports that are read whole. One row a record, or an error."""

    def each(b: pa.RecordBatch) -> Iterator[dict[str, Any]]:
        for i in range(b.num_rows):
            path, sha, content = (b.column(c)[i].as_py() for c in ("path", "sha256", "content"))
            content = content or b""
            if content.startswith(b"ElfFile\0"):
                found: Iterator[dict[str, Any]] = iter([{"error": "binary event log: export it as XML or JSON"}])
            elif content.lstrip()[:1] in (b"[", b"{") or path.lower().endswith(".json"):
                found = json_records(content)
            else:
                found = xml_records(content, b"sysmon" in content[:65536].lower())
            n = 0
            for r in found:
                yield _usable(r) | {"path": path, "sha256": sha, "record_index": n}
                n += not r.get("error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(each(b))

    return files.select("path", "sha256", "content").mapInArrow(run, RECORD)


_OPEN = re.compile(r"<Event[\s/>]")
_BETWEEN = r"(?:\s|<!--.*?-->)*"
_HEAD = re.compile(rf"(?s)\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->)*(<[\w.-]+(?:\s[^<>]*)?>)?{_BETWEEN}")
_TAIL = re.compile(rf"(?s){_BETWEEN}(</[\w.-]+\s*>)?{_BETWEEN}")


def xml_piece(text: str, root: str) -> tuple[list[dict[str, Any]], int, int]:
    """(records, roots begun, roots ended) of what stands before one </Event>, or after the last. root: the start tag around the records."""
    begin = _OPEN.search(text)
    if begin is None:
        tail = _TAIL.fullmatch(text)
        return ([], 0, int(tail[1] is not None)) if tail else ([{"error": "malformed XML"}], 0, 0)
    head = _HEAD.fullmatch(text[: begin.start()])
    if head is None:
        return [{"error": "malformed XML"}], 0, 0
    name = re.match(r"<([\w.-]+)", root)
    try:
        tree = ET.fromstring(f"{root}{text[begin.start():]}</Event></{name[1]}>" if name else f"{text[begin.start():]}</Event>")
    except ET.ParseError as fault:
        return [{"error": f"malformed XML: {fault}"}], 0, 0
    return [xml_record(e) for e in ([tree] if _name(tree.tag) == "Event" else tree) if _name(e.tag) == "Event"], int(head[1] is not None), 0


def form(content: Column, kind: Column) -> Column:
    """How an export can be cut: 'xml' at </Event>, 'lines' at line ends, null not at all. A native expression on the file's head."""
    head = F.decode(F.substring(content, 1, 65536), "ISO-8859-1")
    start = F.ltrim(F.regexp_replace(head, "^ï»¿", ""))
    plain = (kind == "windows") & ~head.contains("\x00") & ~start.rlike(r"(?i)^<\?xml[^>]*encoding\s*=\s*[\"'](?!utf-8)")
    lines = r"^\{[^\r\n]*\}[ \t]*(?:\r?\n[ \t]*)+\{"
    return F.when(plain & start.startswith("<") & start.contains("</Event>"), "xml").when(plain & start.rlike(lines), "lines")


def root_tag(content: Column) -> Column:
    """The start tag around an XML export's records, or nothing."""
    head = F.decode(F.substring(content, 1, 65536), "ISO-8859-1")
    tag = F.regexp_extract(head, r"(?s)^(?:ï»¿)?(?:\s|<\?.*?\?>|<!--.*?-->)*(<[A-Za-z][^<>]*>)", 1)
    return F.when(tag.rlike(r"^<Event[\s/>]"), "").otherwise(tag)


def listed(paths: list[str]) -> list[str]:
    """Paths as Spark's readers take them, which see patterns in them."""
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]


_PIECE = RECORD + ", block long, m long, j int, begun int, ended int, bytes long"


def pieces(spark: SparkSession, facts: DataFrame, how: str) -> DataFrame | None:
    """Records of the files of one form, one piece of text at a time, with their places; None if there is no such file.

    facts: (path, uri, sha256, form, root), a written table. A file's paths are listed on the driver, as in every read.
    """
    own = facts.filter(F.col("form") == how)
    paths = [r["path"] for r in own.select("path").collect()]
    if not paths:
        return None
    text = spark.read.option("lineSep", "</Event>" if how == "xml" else "\n").text(listed(paths))
    placed = text.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    both = placed.join(own.select("uri", "path", "sha256", "root"), "uri")
    schema = pa.schema([*_SCHEMA, *[(n, pa.int64() if n in ("block", "m", "bytes") else pa.int32()) for n in ("block", "m", "j", "begun", "ended", "bytes")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                value = r["value"].decode("utf-8", "replace")
                found, begun, ended = xml_piece(value, r["root"]) if how == "xml" else (json_line(value.removeprefix("\ufeff")), 0, 0)
                base = {n: r[n] for n in ("path", "sha256", "block", "m")} | {"begun": begun, "ended": ended, "bytes": len(r["value"])}
                # A piece without a record is a row too: the file's end.
                for j, x in enumerate(found or [{"kind": "end"}]):
                    rows.append({n: None for n in schema.names} | base | (x if x.get("kind") == "end" else _usable(x)) | {"j": j} | ({"begun": 0, "ended": 0, "bytes": 0} if j else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return both.select("path", "sha256", "root", "block", "m", F.col("value").cast("binary").alias("value")).mapInArrow(run, _PIECE)


def in_order(found: DataFrame) -> DataFrame:
    """Rows of pieces() as those of records(): a record's number counts the good ones before it in its file, which has a size bound."""
    before = Window.partitionBy("path").orderBy("block", "m", "j").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.col("error").isNull().cast("int")).over(before), F.lit(0)).cast("int")
    own = found.filter("kind IS NULL OR kind <> 'end'").withColumn("record_index", number)
    return own.select(*[F.col(x.split()[0]) for x in RECORD.split(", ")])


def faulty(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(path): XML files whose pieces don't make a whole file: a bad piece, something after the end, an end that is missing."""
    place = F.struct("block", "m")
    last = F.col("kind") == "end"
    told = found.groupBy("path").agg(
        F.max(F.col("error").isNotNull().cast("int")).alias("bad"), F.sum("begun").alias("begun"), F.sum("ended").alias("ended"), F.count_if(last).alias("ends"),
        F.count_if(F.col("j") == 0).alias("n"), F.sum("bytes").alias("bytes"), F.max(place).alias("at"), F.max(F.when(last, place)).alias("end"),
    )
    whole = told.join(facts.select("path", "size", "bom"), "path")
    # Each piece but a file's last stands before an end tag of eight bytes.
    cut = F.col("end").isNull() & (F.col("bytes") + 8 * F.col("n") > F.col("size") - F.when(F.col("bom"), 3).otherwise(0))
    odd = (F.col("bad") == 1) | (F.col("begun") > 1) | (F.col("begun") != F.col("ended")) | (F.col("ends") > 1) | (F.col("end").isNotNull() & (F.col("end") != F.col("at"))) | cut
    return whole.filter(odd).select("path")


_SCHEMA = pa.schema([(n, pa.string()) for n in ("path", "sha256", "kind")] + [("record_index", pa.int32())] + [(n, pa.string()) for n in ("event_id", "channel", "time", "computer", "user_id")] + [("data", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def _d(name: str) -> Column:
    return S.blank(F.try_element_at("data", F.lit(name)))


def _first(*names: str) -> Column:
    return F.coalesce(*[_d(n) for n in names])


def _by(**cases: Column) -> Column:
    """The value for the record's id; keys are e1, e3, ..."""
    out = F.lit(None)
    for key, value in cases.items():
        out = F.when(F.col("event_id") == key[1:], value).otherwise(out)
    return out


def _raw() -> Column:
    pairs = F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.array_join(pairs, " | "), 1, 300)


def normalized(recs: DataFrame, ingest_time: str, default_host: str | None = None) -> DataFrame:
    """Event columns of usable records, with provenance; a time that can't be read is null.

    recs: a written table, read once for each kind of record, whose projections are small enough to be compiled.
    """
    parts = [_normalized(recs.filter((F.col("kind") == kind) & F.col("error").isNull()), kind, ingest_time, default_host) for kind in KINDS]
    return reduce(DataFrame.unionByName, parts)


def _normalized(recs: DataFrame, kind: str, ingest_time: str, default_host: str | None) -> DataFrame:
    eid = F.col("event_id")
    qualified = lambda p: S.qualified_user(_d(f"{p}DomainName"), _d(f"{p}UserName"))
    original = S.blank(F.col("time"))
    own: dict[str, Column] = {"source": F.concat(F.lit("evtx:"), F.coalesce("channel", F.lit("unknown"))), "user": S.blank(F.col("user_id")), "process_id": S.parse_pid(_d("ProcessId")), "parent_id": S.parse_pid(_d("ParentProcessId")), "raw": _raw()}
    image, parent, command = _d("Image"), _d("ParentImage"), _d("CommandLine")
    if kind == "sysmon":
        # A record without the time of its log has one of its own.
        original = F.coalesce(original, _d("UtcTime"))
        net, key = eid == "3", eid.isin("12", "13", "14")
        own |= {
            "source": F.lit("sysmon"),
            "user": _d("User"),
            "src_ip": F.when(net, _d("SourceIp")),
            "dst_ip": F.when(net, _d("DestinationIp")),
            "src_port": F.when(net, S.parse_port(_d("SourcePort"))),
            "dst_port": F.when(net, S.parse_port(_d("DestinationPort"))),
            "file_path": _by(e11=_d("TargetFilename"), e7=_d("ImageLoaded")),
            "registry_key": F.when(key, _d("TargetObject")),
            "hashes": S.parse_hashes(_d("Hashes")),
            "raw": F.when(key, S.excerpt(_d("EventType"), _d("Details"))).otherwise(_raw()),
        }
    elif kind == "security":
        start = eid == "4688"
        image, parent = F.when(start, _d("NewProcessName")).otherwise(_d("Image")), _d("ParentProcessName")
        own |= {
            "source": F.lit("evtx:Security"),
            "user": F.when(eid.isin("4624", "4625", "4634", "4647"), qualified("Target")).otherwise(F.coalesce(qualified("Subject"), qualified("Target"))),
            "process_id": F.when(start, F.coalesce(S.parse_pid(_d("NewProcessId")), S.parse_pid(_d("ProcessId")))).otherwise(own["process_id"]),
            "parent_id": F.when(start, S.parse_pid(_d("ProcessId"))).otherwise(own["parent_id"]),
            "src_ip": F.when(eid.isin("4624", "4625"), _d("IpAddress")),
        }
    elif kind == "powershell":
        command = F.when(eid == "4104", F.substring(_d("ScriptBlockText"), 1, 500)).when(eid == "4103", F.substring(_d("ContextInfo"), 1, 500))
        own |= {"source": F.lit("powershell"), "file_path": _d("Path"), "raw": F.when(eid == "4104", _d("ScriptBlockText")).otherwise(_raw())}
    plain = F.when(original.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$"), F.concat(F.translate(original, " ", "T"), F.lit("Z"))).otherwise(original)
    own |= {
        "timestamp": S.normalize_timestamp(plain if kind == "sysmon" else original),
        "timestamp_original": original,
        "event_id": eid,
        "host": F.coalesce(S.blank(F.col("computer")), F.lit(default_host)),
        "process_name": S.parser_basename(image),
        "parent_name": S.parser_basename(parent),
        "command_line": command,
        "flags": S.encoded_flag(F.coalesce(command, F.lit(""))),
        "provenance": F.struct(F.col("path").alias("source_file"), F.col("record_index"), F.lit(f"windows-{kind}").alias("parser_name"), F.lit("1").alias("parser_version"), F.lit(ingest_time).alias("ingest_time"), F.col("sha256").alias("source_sha256")),
    }
    return conform(recs.select(*[c.alias(n) for n, c in own.items()]))
