"""Case reports as JSON, Markdown, HTML and CSV; narratives (survey B6, B7, E7, E8, J3). What is collected is aggregates, top lists and findings."""

from __future__ import annotations

import csv
import html
import io
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import attack, correlate, entities, lineage, query
from .schema import SEVERITIES, severity_rank
from .sources.records import safe_csv
from .tables import written

#: Fixed value: a report's sections, in order.
SECTIONS = ("meta", "executive_summary", "what_this_report_does_not_claim", "methodology", "case_overview", "timeline_highlights", "process_lineage", "detections", "attack_coverage", "correlations", "entities", "analyst_notes", "limitations", "chain_of_custody")
#: Lists in a report end after so many rows, and say so.
SHOWN = 200


def _rows(df: DataFrame, n: int = SHOWN) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


def narrative(events: DataFrame, findings: DataFrame, members: DataFrame, root: int) -> dict[str, Any]:
    """What was observed in a cluster, what its findings infer, and what evidence the case lacks; each list ends after SHOWN rows."""
    own = events.join(members.filter(F.col("root") == root).select("id"), "id")
    held = correlate.attached(findings, members, events).filter(F.col("root") == root)
    lines = own.orderBy("timestamp", "id").select("id", query.event_line().alias("line"))
    # The cluster asks, and the whole case answers.
    missing = {n: [r[0] for r in getattr(correlate, f"missing_{n}")(own, events).select(c).distinct().orderBy(c).limit(SHOWN).collect()] for n, c in (("prefetch", "base"), ("persist", "target"), ("network", "dst"), ("file", "file_path"))}
    return {"root": root, "observed": _rows(lines), "inferred": _rows(held.select("uid", "rule_id", "title", "severity", "confidence", "confidence_reason", "event_id", "detail", "why", "what", "observed", "inferred", "mitre").orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "event_id")), "missing": missing}


def build(case_id: str, events: DataFrame, findings: DataFrame, evidence: DataFrame, notes: DataFrame, made: str) -> dict[str, Any]:
    links = correlate.stats(correlate.link_classes(written(correlate.prepared(events))))
    members = written(correlate.clusters(events))
    inst = written(lineage.instances(events))
    worst = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    total = events.agg(F.count("*").alias("n"), F.count_if(query.timed()).alias("t"), F.count_distinct("host").alias("h")).first()
    linked = members.count()
    ranked = correlate.ranked(events, findings, members)
    ordered = findings.orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "event_id")
    out = {
        "meta": {"case_id": case_id, "created": made, "tool": "evtrail"},
        "executive_summary": {"events": total["n"], "hosts": total["h"], "findings": sum(worst.values()), "by_severity": {s: worst.get(s, 0) for s in SEVERITIES}},
        "what_this_report_does_not_claim": ["No finding here proves an intrusion.", "A missing record isn't evidence that nothing happened."],
        "methodology": ["Rules and links state what they saw (observed) apart from what it may mean (inferred).", "Records without a time of their own are listed, and never ordered."],
        "case_overview": {"timed": total["t"], "untimed": total["n"] - total["t"], "coverage": _rows(query.coverage(events).orderBy("source"))},
        "timeline_highlights": _rows(query.highlights(events).select("end", "id", "summary")),
        "process_lineage": {"instances": inst.count(), "orphans": lineage.parents(inst).filter("candidates = 0").count(), "reused_pids": _rows(lineage.pid_reuse(inst).orderBy("h", "pid"))},
        "detections": _rows(ordered),
        "attack_coverage": {"seen": _rows(attack.coverage(findings).orderBy("technique")), "gaps": _rows(attack.gaps(findings).orderBy("technique")), "unobservable": _rows(attack.unobservable(events.sparkSession))},
        "correlations": {"linkages_by_kind": {r["kind"]: r["n"] for r in links.collect()}, "uncorrelated_events": total["n"] - linked, "clusters": _rows(ranked.orderBy("cluster_id"), 20)},
        "entities": _rows(entities.entities(events).orderBy(F.desc("count"), "type", "value"), 50),
        "analyst_notes": _rows(notes.orderBy("at")),
        "limitations": [f"Lists end after {SHOWN} rows."],
        "chain_of_custody": _rows(evidence.select("path", "size", "sha256").orderBy("path")),
    }
    assert tuple(out) == SECTIONS
    return out


def to_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str) + "\n"


def _blocks(value: Any, depth: int = 0) -> list[tuple[int, str]]:
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                out += [(depth, str(k)), *_blocks(v, depth + 1)]
            else:
                out.append((depth, f"{k}: {v if not isinstance(v, (dict, list)) else '-'}"))
        return out
    if isinstance(value, list):
        out = []
        for x in value:
            out.append((depth, ", ".join(f"{k}={v}" for k, v in x.items() if v is not None) if isinstance(x, dict) else str(x)))
        return out
    return [(depth, str(value))]


def to_markdown(report: dict[str, Any]) -> str:
    safe = lambda t: "".join("\\" + c if c in "\\`*_|<>[]#" else c for c in t).replace("\n", " ")
    parts = [f"# Case {safe(str(report['meta']['case_id']))}"]
    for name in SECTIONS:
        parts.append(f"\n## {name.replace('_', ' ').capitalize()}\n")
        parts += [f"{'  ' * d}- {safe(t)}" for d, t in _blocks(report[name])]
    return "\n".join(parts) + "\n"


def to_html(report: dict[str, Any]) -> str:
    """One file without references to anything outside it."""
    body = []
    for name in SECTIONS:
        rows = "".join(f'<li style="margin-left:{2 * d}em">{html.escape(t)}</li>' for d, t in _blocks(report[name]))
        body.append(f"<section><h2>{html.escape(name.replace('_', ' ').capitalize())}</h2><ul>{rows}</ul></section>")
    title = html.escape(str(report["meta"]["case_id"]))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;margin:2em}}li{{list-style:none}}</style></head><body><h1>{title}</h1>{"".join(body)}</body></html>\n'


def to_csv(findings: DataFrame) -> str:
    cells = safe_csv(findings.orderBy(F.desc(severity_rank(F.col("severity"))), "rule_id", "event_id"))
    out = io.StringIO()
    put = csv.writer(out, lineterminator="\n")
    put.writerow(cells.columns)
    for r in cells.toLocalIterator():
        put.writerow(r)
    return out.getvalue()
