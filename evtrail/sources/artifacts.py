"""Prefetch, hive, task and service files as normalized events (survey A3, A4, A11-A15)."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import conform
from . import binary

FLAT = "path string, sha256 string, kind string, record_index int, timestamp string, timestamp_original string, event_id string, user string, process_name string, command_line string, file_path string, registry_key string, raw string, error string, start string"
_NAMES = [x.split()[0] for x in FLAT.split(", ")]
_SCHEMA = pa.schema([(n, pa.int32() if n == "record_index" else pa.string()) for n in _NAMES])
#: Places where an exported channel names itself.
CHANNELS = (("sysmon", rb"(?i)microsoft-windows-sysmon"), ("powershell", rb"(?i)powershell"), ("security", rb"(?i)<channel>\s*security|microsoft-windows-security-auditing"))


def sniff(content: Column) -> Column:
    """The kind of a file by its first 64 KiB: a native expression."""
    head = F.substring(content, 1, 65536)
    magic = lambda at, n: F.hex(F.substring(head, at, n))
    text = F.translate(F.decode(head, "ISO-8859-1"), "\x00", "")
    start = F.ltrim(F.regexp_replace(text, "^(?:ï»¿|ÿþ|þÿ)", ""))
    return (
        F.when(magic(1, 8) == "456C6646696C6500", "evtx")
        .when(magic(1, 4) == "72656766", "registry")
        .when((magic(5, 4) == "53434341") | (magic(1, 4) == "4D414D04"), "prefetch")
        .when(start.startswith("<") & text.rlike(r"<(?:\w+:)?Task[\s>]"), "tasks")
        .when((start.startswith("<") | start.startswith("{") | start.startswith("[")) & text.rlike(r"(?i)<(?:\w+:)?Event[\s>]|\"(?:EventID|EventData|Events)\""), "windows")
        .when((start.startswith("{") | start.startswith("[")) & text.rlike(r"(?i)\"(?:services|image_path|ImagePath|ServiceName)\""), "services")
    )


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def task_rows(content: bytes) -> Iterator[dict[str, Any]]:
    """A row for each Exec of a task; its time is the first start boundary, else the registration date, else none."""
    root = ET.fromstring(content)
    pick = lambda *path: next((x for x in _below(root, path)), None)
    text = lambda e: (e.text or "").strip() if e is not None and e.text else ""
    uri = text(pick("RegistrationInfo", "URI"))
    triggers = [(_tag(t), text(next((b for b in t if _tag(b) == "StartBoundary"), None))) for part in root if _tag(part) == "Triggers" for t in part]
    time = next((b for _, b in triggers if b), "") or text(pick("RegistrationInfo", "Date"))
    user = text(pick("Principals", "Principal", "UserId"))
    about = ",".join(x for x in (uri, text(pick("RegistrationInfo", "Author")), text(pick("RegistrationInfo", "Description")), ";".join(f"{k}@{b}" if b else k for k, b in triggers)) if x)
    for run in (x for part in root if _tag(part) == "Actions" for x in part if _tag(x) == "Exec"):
        parts = {_tag(x): text(x) for x in run}
        command = parts.get("Command", "")
        yield {"event_id": "task", "timestamp": time, "timestamp_original": time or None, "user": user or None, "file_path": command.strip('"') or None, "process_name": re.split(r"[\\/]", command.strip('"'))[-1] or None, "command_line": f"{command} {parts.get('Arguments', '')}".strip() or None, "raw": about[:300] or None}


def _below(e: ET.Element, path: tuple[str, ...]) -> Iterator[ET.Element]:
    if not path:
        yield e
        return
    for x in e:
        if _tag(x) == path[0]:
            yield from _below(x, path[1:])


def service_rows(content: bytes) -> Iterator[dict[str, Any]]:
    whole = json.loads(content.decode("utf-8-sig", "replace"))
    for s in whole.get("services", []) if isinstance(whole, dict) else whole:
        get = lambda *names, s=s: next((str(s[n]) for n in names if s.get(n) not in (None, "")), None)
        if not isinstance(s, dict) or not get("name", "ServiceName"):
            yield {"error": "a service without a name"}
            continue
        path = get("image_path", "ImagePath")
        yield {"event_id": "service", "user": get("account", "ObjectName"), "file_path": _exe(path), "process_name": re.split(r"[\\/]", _exe(path) or "")[-1] or None, "command_line": path, "start": get("start_type", "Start"), "raw": ",".join(x for x in (get("name", "ServiceName"), get("display_name", "DisplayName")) if x)}


def _exe(text: str | None) -> str | None:
    if not text:
        return None
    m = re.match(r'(?i)\s*"?(.*?\.exe)', text)
    return m.group(1) if m else text.replace('"', "").strip()


def prefetch_rows(content: bytes) -> Iterator[dict[str, Any]]:
    p = binary.prefetch(content)
    last = p["last_runs"][0] if p["last_runs"] else None
    own = next((f for f in p["files"] if f.upper().endswith("\\" + p["executable"].upper())), p["executable"])
    yield {"event_id": "prefetch", "timestamp": last, "timestamp_original": f"last run ({len(p['last_runs'])} recorded)" if last else None, "process_name": p["executable"], "file_path": own, "raw": f"run_count={p['runs']},hash={p['hash']},version={p['version']},files={len(p['files'])}"}


def hive_rows(content: bytes) -> Iterator[dict[str, Any]]:
    """Values of the Run keys and the services of the first services key there is."""
    hive = binary.Hive(content)
    for path in binary.RUN_PATHS:
        if (key := hive.find(path)) is not None:
            for name, _, data in hive.values(key):
                text = data if isinstance(data, str) else str(data)
                yield {"event_id": "run-key", "timestamp": hive.written(key), "timestamp_original": hive.written(key), "registry_key": f"{path}\\{name}", "file_path": _exe(text), "command_line": text, "raw": f'{name}="{text}"'[:300]}
    top = next((k for k in map(hive.find, binary.SERVICE_PATHS) if k is not None), None)
    for key in hive.subkeys(top) if top is not None else []:
        v = {n.lower(): d for n, _, d in hive.values(key)}
        if v.get("imagepath"):
            path = str(v["imagepath"])
            yield {"kind": "services", "event_id": "service", "timestamp": hive.written(key), "timestamp_original": hive.written(key), "user": v.get("objectname") and str(v["objectname"]), "file_path": _exe(path), "process_name": re.split(r"[\\/]", _exe(path) or "")[-1] or None, "command_line": path, "start": None if v.get("start") is None else str(v["start"]), "raw": hive.name(key)}


READERS = {"tasks": task_rows, "services": service_rows, "prefetch": prefetch_rows, "registry": hive_rows}


#: Rows that a task holds before it hands them on.
HELD = 10_000


def records(files: DataFrame) -> DataFrame:
    """files: (path, sha256, kind, content). Rows of FLAT; a file that can't be read is one error row."""

    def of(path: str, sha: str, kind: str, content: bytes | None) -> list[dict[str, Any]]:
        base = dict.fromkeys(_NAMES) | {"path": path, "sha256": sha, "kind": kind}
        n, good = 0, []
        try:
            for r in READERS[kind](content or b""):
                good.append(base | {"record_index": n} | r)
                n += "error" not in r
        except (ET.ParseError, ValueError, KeyError, TypeError, AttributeError) as fault:
            return [base | {"error": f"{kind}: {fault}"}]
        return good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict[str, Any]] = []
            for i in range(b.num_rows):
                rows += of(*(b.column(c)[i].as_py() for c in ("path", "sha256", "kind", "content")))
                # A file's rows stand or fall together, so a batch may pass the number by one file's.
                if len(rows) >= HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("path", "sha256", "kind", "content").mapInArrow(run, FLAT)


def normalized(recs: DataFrame, ingest_time: str, default_host: str | None = None) -> DataFrame:
    kind = F.col("kind")
    system = F.lower("user").isin(*S.SYSTEM_ACCOUNTS)
    temp = F.coalesce("file_path", F.lit("")).rlike(S.TEMP_ONLY)
    task_flags = F.array_compact(F.array(F.when(system, "runs-as-system"), F.when(temp, "action-in-temp-dir")))
    out = recs.filter("error IS NULL").select(
        F.coalesce(S.normalize_timestamp(F.col("timestamp")), S.normalize_timestamp(F.lit(ingest_time))).alias("timestamp"),
        F.when(F.col("timestamp").isNotNull() & (F.col("timestamp") != ""), F.col("timestamp_original")).alias("timestamp_original"),
        kind.alias("source"),
        "event_id",
        F.lit(default_host).cast("string").alias("host"),
        "user",
        "process_name",
        "command_line",
        "file_path",
        "registry_key",
        "raw",
        F.when(kind == "tasks", task_flags).when(kind == "services", S.service_flags(F.col("command_line"), F.col("start"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.struct(F.col("path").alias("source_file"), "record_index", F.concat(F.lit("artifact-"), kind).alias("parser_name"), F.lit("1").alias("parser_version"), F.lit(ingest_time).alias("ingest_time"), F.col("sha256").alias("source_sha256")).alias("provenance"),
    )
    return conform(out)
