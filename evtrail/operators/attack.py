"""ATT&CK techniques: the table, coverage by findings, gaps (survey A21, G10, G13, H7)."""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import catalog

#: Technique id, name, tactics, and whether the event sources can show it.
TECHNIQUES = (
    ("T1003.001", "LSASS Memory", "Credential Access", False),
    ("T1016", "System Network Configuration Discovery", "Discovery", True),
    ("T1021.001", "Remote Desktop Protocol", "Lateral Movement", True),
    ("T1033", "System Owner/User Discovery", "Discovery", True),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration", True),
    ("T1049", "System Network Connections Discovery", "Discovery", True),
    ("T1053.005", "Scheduled Task/Job", "Execution,Persistence,Privilege Escalation", True),
    ("T1057", "Process Discovery", "Discovery", True),
    ("T1059.001", "PowerShell", "Execution", True),
    ("T1059.003", "Windows Command Shell", "Execution", True),
    ("T1070.001", "Clear Windows Event Logs", "Defense Evasion", False),
    ("T1070.004", "File Deletion", "Defense Evasion", False),
    ("T1071", "Application Layer Protocol", "Command and Control", True),
    ("T1078", "Valid Accounts", "Defense Evasion,Persistence,Privilege Escalation,Initial Access", True),
    ("T1083", "File and Directory Discovery", "Discovery", True),
    ("T1105", "Ingress Tool Transfer", "Command and Control", True),
    ("T1110", "Brute Force", "Credential Access", True),
    ("T1135", "Network Share Discovery", "Discovery", True),
    ("T1204.002", "Malicious File", "Execution", True),
    ("T1543.003", "Windows Service", "Persistence,Privilege Escalation", True),
    ("T1547.001", "Registry Run Keys / Startup Folder", "Persistence", True),
    ("T1566.001", "Spearphishing Attachment", "Initial Access", True),
    ("T1571", "Non-Standard Port", "Command and Control", True),
)


_TABLE = "technique string, name string, tactics string, observable boolean"


def techniques(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The table of techniques: this engine's, or that of a JSON file."""
    return spark.createDataFrame(list(TECHNIQUES) if path is None else load_techniques(path), _TABLE)


def load_techniques(path: str) -> list[tuple[str, str, str, bool]]:
    """A file's techniques: {"techniques": [{"id", "name", "tactics": [...], "observable"}, ...]}. Any fault refuses the whole file."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))["techniques"]
        rows = [(t["id"].strip().upper(), t["name"].strip(), [x.strip() for x in t["tactics"]], bool(t.get("observable", True))) for t in given]
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as fault:
        raise ValueError(f"{path}: not a table of techniques ({fault!r})") from fault
    wrong = [i for i, name, tactics, _ in rows if not re.fullmatch(r"T\d{4}(\.\d{3})?", i) or not name or not tactics or not all(tactics)]
    twice = sorted(i for i, n in Counter(r[0] for r in rows).items() if n > 1)
    if not rows or wrong or twice:
        raise ValueError(f"{path}: " + ("no techniques" if not rows else f"unusable: {', '.join(wrong)}" if wrong else f"given twice: {', '.join(twice)}"))
    return [(i, name, ",".join(tactics), seen) for i, name, tactics, seen in rows]


def _by_rule(findings: DataFrame) -> DataFrame:
    spark = findings.sparkSession
    rules = catalog(spark).select("rule_id", F.explode("mitre").alias("technique"))
    # The catalog has a fixed number of rows.
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(rules), "rule_id")


def coverage(findings: DataFrame) -> DataFrame:
    """technique, name, findings, rules of techniques that findings point to."""
    found = _by_rule(findings).groupBy("technique").agg(F.sum("n").cast("long").alias("findings"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    return found.join(F.broadcast(techniques(findings.sparkSession)), "technique").select("technique", "name", "findings", "rules")


def gaps(findings: DataFrame) -> DataFrame:
    """Techniques that could be seen and weren't."""
    seen = _by_rule(findings).select("technique").distinct()
    return techniques(findings.sparkSession).filter("observable").join(seen, "technique", "left_anti").select("technique", "name")


def unobservable(spark: SparkSession) -> DataFrame:
    return techniques(spark).filter("NOT observable").select("technique", "name")


def mapping_faults(spark: SparkSession) -> DataFrame:
    """Rules whose techniques aren't in the table, or that have none; there should be none."""
    rules = catalog(spark).select("rule_id", F.explode_outer("mitre").alias("technique"))
    return rules.join(techniques(spark), "technique", "left_anti").select("rule_id", "technique")


def top_techniques(findings: DataFrame, n: int = 10) -> DataFrame:
    return coverage(findings).select("technique", "findings").orderBy(F.desc("findings"), "technique").limit(n)
