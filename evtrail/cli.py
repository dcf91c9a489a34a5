"""A thin command line over CaseSession. Exit codes: 0 well, 1 findings, 2 error (survey 2.15)."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import batch, schemas, settings
from .operators import sigma
from .session import CaseSession
from .store import SCHEMA_VERSION


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evtrail")
    p.add_argument("--state-dir")
    p.add_argument("--config")
    p.add_argument("--case", default="default")
    p.add_argument("--rows", type=int, default=1000, help="rows of a result that are printed")
    p.add_argument("--as", dest="shape", choices=["json", "table", "lines"], default="json")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **typed: Any) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a, **typed.get(a.lstrip("-").replace("-", "_"), {}))

    count = {"type": int}
    add("create", "--name")
    add("cases")
    add("ingest", "path", "--source", "--fixture", "--no-parse", "--no-recursive", fixture={"action": "store_true"}, no_parse={"action": "store_true"}, no_recursive={"action": "store_true"})
    add("events", "--host", "--user", "--event-id", "--process", "--keyword", "--limit", "--offset", limit=count, offset=count)
    add("timeline", "--from", "--to", "--source", "--limit", limit=count)
    add("coverage")
    add("lineage", "--pid", "--image", pid=count)
    add("entities", "--type")
    add("detect", "--rule", "--severity", rule={"action": "append"})
    add("rules")
    add("schema", "which", which={"nargs": "?"})
    add("config")
    add("migrate")
    add("mitre")
    add("techniques")
    add("sigma", "--rule", "--list", list={"action": "store_true"})
    add("correlate")
    add("narrative", "--cluster", cluster=count | {"default": 0})
    add("report", "--output", "--format", output={"default": "."}, format={"default": "json"})
    add("notes", "--add", "--author", "--list", list={"action": "store_true"})
    add("audit", "--limit", limit=count | {"default": 50})
    add("registry", "hive", "key")
    add("batch", "folder", "--output", "--severity", output={"required": True}, severity={"default": "informational"})
    add("export", "--what", "--output", what={"choices": ["events", "findings"], "default": "events"}, output={"required": True})
    return p


def _given(**values: Any) -> dict[str, Any]:
    return {k: v for k, v in values.items() if v is not None}


def execute(a: argparse.Namespace, spark: SparkSession, own: settings.Settings) -> Any:
    s = CaseSession(spark, settings.state_folder(a.state_dir, own), a.case)
    match a.command:
        case "migrate":
            return {"was": s.migrate(), "is": SCHEMA_VERSION}
        case "create":
            return {"case": s.create(a.name or "").case_id}
        case "cases":
            return s.store.cases()
        case "ingest":
            return s.load_jsonl(a.path) if a.fixture else s.ingest(a.path, recursive=not a.no_recursive, source=a.source, parse=not a.no_parse)
        case "events":
            return s.events(**_given(limit=a.limit, offset=a.offset, host=a.host, user=a.user, event_id=a.event_id, process=a.process, keyword=a.keyword))
        case "timeline":
            return s.timeline(**_given(start=getattr(a, "from"), end=a.to, source=a.source, limit=a.limit))
        case "lineage":
            return s.lineage(a.pid, a.image)
        case "entities":
            return s.entities(a.type)
        case "detect":
            return s.detect(a.rule, a.severity or own.default_severity)
        case "mitre":
            return s.attack_coverage()
        case "sigma":
            return [{"id": r.id, "title": r.title, "level": r.level} for r in sigma.samples()] if a.list else s.sigma(a.rule)
        case "correlate":
            return s.clusters()
        case "narrative":
            return s.narrative(a.cluster)
        case "report":
            return s.report(a.output, (a.format,))
        case "notes":
            return s.add_note(a.add, a.author or own.analyst_name or "") if a.add else s.notes()
        case "audit":
            return s.audit(a.limit)
        case "registry":
            return s.read_hive(a.hive, a.key)
        case "batch":
            return batch.run(spark, a.folder, a.output, a.severity)
        case "export":
            return s.export(a.what, a.output)
        case name:
            return getattr(s, name)()


def table(rows: list[dict[str, Any]]) -> str:
    """Rows as columns of text, as wide as their widest cell, 60 characters at most."""
    if not rows:
        return "(none)"
    cell = lambda v: "" if v is None else " ".join((json.dumps(v, default=str) if isinstance(v, (dict, list)) else str(v)).split())
    names = list(rows[0])
    text = [names, *[[c if len(c := cell(r.get(n))) <= 60 else c[:59] + "…" for n in names] for r in rows]]
    wide = [max(len(line[i]) for line in text) for i in range(len(names))]
    out = ["  ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in text]
    return "\n".join([out[0], "  ".join("-" * w for w in wide), *out[1:]])


def shown(result: dict[str, Any], shape: str) -> str:
    """A command's result as it is printed."""
    body = result.get("result")
    if shape == "json" or result["status"] == "error":
        return json.dumps(result, default=str, sort_keys=True)
    if isinstance(body, dict):
        body = [{"name": k, "value": v} for k, v in body.items()]
    rows = body if isinstance(body, list) and all(isinstance(x, dict) for x in body) else [{"value": x} for x in (body if isinstance(body, list) else [body])]
    more = "\n(more rows are there)" if result.get("truncated") else ""
    return (table(rows) if shape == "table" else "\n".join(json.dumps(r, default=str, sort_keys=True) for r in rows)) + more


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    result: dict[str, Any] = {"command": a.command, "status": "ok"}
    code = 0
    try:
        own = settings.load(a.config)
        if a.command == "config":
            result["result"] = own.as_dict()
        elif a.command == "schema":
            result["result"] = schemas.named(a.which) if a.which else sorted(schemas.SCHEMAS)
        else:
            out = execute(a, spark or SparkSession.builder.appName("evtrail").getOrCreate(), own)
            if isinstance(out, DataFrame):
                rows = out.limit(a.rows + 1).collect()
                out, result["truncated"] = [r.asDict(recursive=True) for r in rows[: a.rows]], len(rows) > a.rows
            result["result"] = out
            code = 1 if a.command in ("detect", "sigma") and out and not getattr(a, "list", False) else 0
    except (ValueError, KeyError, OSError) as fault:
        result, code = {"command": a.command, "status": "error", "error": str(fault)}, 2
    print(shown(result, a.shape))
    return code


if __name__ == "__main__":
    sys.exit(main())
