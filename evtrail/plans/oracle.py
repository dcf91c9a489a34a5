"""DuckDB SQL for the queries in queries.py, written from the survey's semantics."""

from __future__ import annotations

from .testdata import EV

#: Fixed values, written out here from the survey's Appendix A and the rules it cites, so that a wrong constant of the engine shows.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
ENCODED = r"(?i)(?:^|\s)-(?:encodedcommand|enc|e)(?:\s|$|=|:)"
ENCODED_PARSER = r"(?i)(?:^|\s)[-/](?:encodedcommand|enc|e)(?:\s|$|=|:)"
WRITABLE = r"(?i)\\temp\\|/temp/|\\tmp\\|/tmp/|\\programdata\\"
RUN_KEY = r"(?i)\\Run(Once)?(\\|$)"
DOWNLOADS = (
    r"(?i)\bInvoke-WebRequest\b|\bIWR\b",
    r"(?i)\bInvoke-RestMethod\b|\bIRM\b",
    r"(?i)Net\.WebClient",
    r"(?i)DownloadString|DownloadFile",
    r"(?i)\bbitsadmin\b.*\btransfer\b|\bStart-BitsTransfer\b",
    r"(?i)\bcertutil\b.*\burlcache\b",
    r"(?i)\bcurl(\.exe)?\b.*\s-[oO]\b|\bwget(\.exe)?\b",
)
OFFICE = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "mspub.exe", "visio.exe", "winproj.exe", "onenote.exe", "msaccess.exe")
SHELLS = ("powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "wmic.exe")
COMMON_PORTS = (20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 88, 110, 115, 119, 123, 135, 139, 143, 161, 162, 389, 443, 445, 464, 500, 514, 515, 554, 587, 636, 993, 995, 1194, 1433, 1723, 1935, 3306, 3389, 4500, 5060, 5061, 5432, 5900, 5985, 5986, 6379, 8000, 8080, 8443, 9200, 27017)
EXTERNAL_V4 = ("192.0.0.9", "192.0.0.10")
#: First address and prefix length of the networks that aren't external.
INTERNAL_V4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
#: rule, severity, confidence, techniques, and the (source, event_id) that it reads.
_STARTS = (("sysmon", "1"), ("evtx:Security", "4688"))
RULES = (
    ("EV-DET-ADMINHOST", "low", 45, ("T1078",), (("evtx:Security", "4624"),)),
    ("EV-DET-BRUTE", "medium", 60, ("T1110",), (("evtx:Security", "4625"),)),
    ("EV-DET-DLPSH", "high", 75, ("T1105",), (*_STARTS, ("powershell", "4104"), ("powershell", "4103"))),
    ("EV-DET-ENCPSH", "high", 80, ("T1059.001",), _STARTS),
    ("EV-DET-OFFICE", "high", 70, ("T1204.002",), _STARTS),
    ("EV-DET-RAREPORT", "low", 40, ("T1571",), (("sysmon", "3"),)),
    ("EV-DET-RUNKEY", "medium", 60, ("T1547.001",), (("registry", "run-key"), ("sysmon", "12"), ("sysmon", "13"), ("sysmon", "14"))),
    ("EV-DET-SVC", "high", 80, ("T1543.003",), (("services", "service"),)),
    ("EV-DET-TASK", "medium", 60, ("T1053.005",), (("tasks", "task"),)),
    ("EV-DET-TEMPEXEC", "medium", 65, ("T1204.002",), _STARTS),
)
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


def ranges() -> list[tuple[int, int]]:
    out = []
    for net, size in INTERNAL_V4:
        a, b, c, d = map(int, net.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        out.append((first, first + 2 ** (32 - size) - 1))
    return out


def iso(sec: str) -> str:
    return f"strftime(to_timestamp({sec}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


def base(c: str) -> str:
    return rf"regexp_extract(lower(trim(coalesce({c}, ''))), '[^\\/]*$', 0)"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def isin(items: tuple) -> str:
    return "(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in items) + ")"


ROW = f'SELECT id, {iso("sec")} AS ts, source, event_id, host, "user", process_name FROM ev'
STARTED = "((source = 'sysmon' AND event_id = '1') OR (source = 'evtx:Security' AND event_id = '4688'))"
IS_RUN_KEY = f"((source = 'registry' AND event_id = 'run-key') OR (source = 'sysmon' AND event_id IN ('12', '13', '14') AND regexp_matches(coalesce(registry_key, ''), '{RUN_KEY}')))"
PERSISTS = f"({IS_RUN_KEY} OR source IN ('tasks', 'services'))"
ANYWHERE = r"""coalesce(nullif(regexp_extract(coalesce(command_line, ''), '(?i)"([^"]+\.exe)"|\b([A-Za-z]:\\[^\s"]+\.exe)', 1), ''), regexp_extract(coalesce(command_line, ''), '(?i)"([^"]+\.exe)"|\b([A-Za-z]:\\[^\s"]+\.exe)', 2))"""
FIRST = r"""CASE WHEN trim(command_line) LIKE '"%' THEN regexp_extract(trim(command_line), '^"([^"]*)"', 1) ELSE regexp_extract(trim(command_line), '^(\S+)', 1) END"""
TOKEN = f"CASE WHEN command_line IS NULL THEN '' WHEN contains({FIRST}, '\\') OR contains({FIRST}, '/') OR lower({FIRST}) LIKE '%.exe' THEN {FIRST} ELSE '' END"
TARGET = f"coalesce(nullif(file_path, ''), nullif({ANYWHERE}, ''), '')"
RULE_TARGET = f"coalesce(nullif({ANYWHERE}, ''), nullif(file_path, ''), '')"
NUMBER = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


def external(c: str) -> str:
    n = NUMBER.format(c)
    return f"({c} IN {isin(EXTERNAL_V4)} OR NOT ({' OR '.join(f'{n} BETWEEN {a} AND {b}' for a, b in ranges())}))"


def name(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '-')"


PID = "coalesce(CAST(process_id AS VARCHAR), 'None')"
BIT = f"({name('process_name')} || CASE WHEN process_id IS NOT NULL THEN '(' || process_id || ')' ELSE '' END)"
SUMMARY = f"""CASE
  WHEN event_id = '1' AND parent_name IS NOT NULL THEN {name('process_name')} || '(' || {PID} || ') started by ' || parent_name || '(' || coalesce(CAST(parent_id AS VARCHAR), 'None') || ')'
  WHEN event_id = '3' AND dst_ip IS NOT NULL THEN {BIT} || ' -> ' || dst_ip || ':' || dst_port || ' (from ' || coalesce(src_ip, '?') || ')'
  WHEN event_id = '11' AND file_path IS NOT NULL THEN {BIT} || ' created file ' || file_path
  WHEN event_id IN ('12', '13', '14') AND registry_key IS NOT NULL THEN {BIT} || ' registry ' || registry_key
  WHEN source LIKE 'prefetch%' THEN {name('process_name')} || ' executed (prefetch evidence)'
  WHEN source LIKE 'registry%' THEN 'persistence: ' || coalesce(registry_key, event_id)
  WHEN source = 'tasks' THEN 'scheduled task: ' || event_id
  WHEN source = 'services' THEN 'service: ' || event_id
  ELSE source || ':' || event_id || ' host=' || {name('host')} || ' user=' || {name('"user"')} || ' process=' || {BIT} END"""
LINE = """trim(source || ':' || event_id || ' ' || concat_ws('; ',
  process_name || coalesce(' (pid ' || process_id || ')', '') || coalesce(': ' || substr(command_line, 1, 80), ''),
  'file ' || file_path, 'registry ' || registry_key, '-> ' || dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '?')))"""

#: Each rule's findings: rule_id, severity, confidence, event_id, detail, evidence (ids by comma).
_one = "CAST(id AS VARCHAR) AS evidence"
DOWNLOAD = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(command_line, ''), '{p}', 0), '')" for p in DOWNLOADS) + ")"
ADMIN = r"(lower(trim(regexp_extract(regexp_extract({0}, '[^\\]*$', 0), '^[^@]*', 0))) = 'administrator' OR regexp_matches(lower(trim(regexp_extract(regexp_extract({0}, '[^\\]*$', 0), '^[^@]*', 0))), '(^|[^a-z])admin([^a-z]|$)'))"
IMAGES = f"(SELECT DISTINCT {base('process_name')} AS image FROM ev WHERE ({STARTED} OR source = 'prefetch') AND {base('process_name')} <> '')"
IMAGES_BY_HOST = IMAGES.replace("SELECT DISTINCT", "SELECT DISTINCT host AS ih,")
POWERSHELL = f"{STARTED} AND {base('process_name')} IN ('powershell.exe', 'pwsh.exe')"
DETECT = {
    "EV-DET-ENCPSH": f"SELECT 'EV-DET-ENCPSH' AS rule_id, 'high' AS severity, 80 AS confidence, id AS event_id, command_line AS detail, {_one} FROM ev WHERE {POWERSHELL} AND regexp_matches(coalesce(command_line, ''), '{ENCODED}')",
    "EV-DET-DLPSH": f"SELECT 'EV-DET-DLPSH' AS rule_id, 'high' AS severity, 75 AS confidence, id AS event_id, {DOWNLOAD} AS detail, {_one} FROM ev WHERE {POWERSHELL} AND {DOWNLOAD} IS NOT NULL",
    "EV-DET-OFFICE": f"SELECT 'EV-DET-OFFICE' AS rule_id, 'high' AS severity, 70 AS confidence, id AS event_id, {base('parent_name')} || ' > ' || {base('process_name')} AS detail, {_one} FROM ev WHERE {STARTED} AND {base('parent_name')} IN {isin(OFFICE)} AND {base('process_name')} IN {isin(SHELLS)}",
    "EV-DET-RUNKEY": f"SELECT 'EV-DET-RUNKEY' AS rule_id, CASE WHEN image IS NULL THEN 'medium' ELSE 'high' END AS severity, CASE WHEN image IS NULL THEN 60 ELSE 85 END AS confidence, id AS event_id, {RULE_TARGET} AS detail, {_one} FROM ev LEFT JOIN {IMAGES} ON image = {base(RULE_TARGET)} WHERE {IS_RUN_KEY}",
    "EV-DET-SVC": f"SELECT 'EV-DET-SVC' AS rule_id, 'high' AS severity, 80 AS confidence, id AS event_id, file_path AS detail, {_one} FROM ev WHERE source = 'services' AND regexp_matches(file_path, '{WRITABLE}')",
    "EV-DET-TASK": f"SELECT 'EV-DET-TASK' AS rule_id, 'medium' AS severity, 60 AS confidence, id AS event_id, file_path AS detail, {_one} FROM ev WHERE source = 'tasks' AND regexp_matches(file_path, '{WRITABLE}')",
    "EV-DET-RAREPORT": f"SELECT 'EV-DET-RAREPORT' AS rule_id, 'low' AS severity, 40 AS confidence, id AS event_id, dst_ip || ':' || dst_port AS detail, {_one} FROM ev WHERE source = 'sysmon' AND event_id = '3' AND dst_port NOT IN {isin(COMMON_PORTS)} AND {external('dst_ip')}",
    "EV-DET-BRUTE": """SELECT 'EV-DET-BRUTE' AS rule_id, 'medium' AS severity, 60 AS confidence, ids[1] AS event_id, u || ' from ' || a || ': ' || len(ids) AS detail, array_to_string(ids, ',') AS evidence FROM (
      SELECT w.u, w.a, list(f.id ORDER BY f.sec, f.id) AS ids FROM (
        SELECT u, a, arg_max(s, (n, -s)) AS s, max(n) AS n FROM (
          SELECT x."user" AS u, x.src_ip AS a, x.sec AS s, count(*) AS n FROM (SELECT DISTINCT "user", src_ip, sec FROM ev WHERE event_id = '4625') x JOIN ev y ON y.event_id = '4625' AND x."user" = y."user" AND x.src_ip = y.src_ip AND y.sec BETWEEN x.sec - 600 AND x.sec GROUP BY ALL) GROUP BY u, a HAVING max(n) >= 5) w
      JOIN ev f ON f.event_id = '4625' AND f."user" = w.u AND f.src_ip = w.a AND f.sec BETWEEN w.s - 600 AND w.s GROUP BY w.u, w.a)""",
    "EV-DET-ADMINHOST": f"""SELECT 'EV-DET-ADMINHOST' AS rule_id, 'low' AS severity, 45 AS confidence, x.id AS event_id, x."user" || ' from ' || x.src_ip || ', before: ' || string_agg(DISTINCT y.src_ip, ', ' ORDER BY y.src_ip) AS detail, CAST(x.id AS VARCHAR) AS evidence
      FROM (SELECT *, row_number() OVER (PARTITION BY "user", src_ip ORDER BY sec, id) AS n FROM ev WHERE event_id = '4624' AND {ADMIN.format('"user"')}) x
      JOIN (SELECT * FROM ev WHERE event_id = '4624') y ON x."user" = y."user" AND (y.sec, y.id) < (x.sec, x.id) WHERE x.n = 1 GROUP BY x.id, x."user", x.src_ip""",
    "EV-DET-TEMPEXEC": f"SELECT 'EV-DET-TEMPEXEC' AS rule_id, 'medium' AS severity, 65 AS confidence, id AS event_id, {TOKEN} AS detail, {_one} FROM ev WHERE {STARTED} AND regexp_matches({TOKEN}, '{WRITABLE}')",
}
RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"
FINDINGS = EV + ", fd AS (" + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in DETECT.values()) + ")\n"
RULE_TECH = values([(r[0], t) for r in RULES for t in r[3]], "rule_id, technique")
TECH = values(list(TECHNIQUES), "technique, name, tactics, observable")
COVERED = FINDINGS + f", cov AS (SELECT technique, count(*) AS n, string_agg(DISTINCT fd.rule_id, ',' ORDER BY fd.rule_id) AS rules FROM fd JOIN {RULE_TECH} ON t.rule_id = fd.rule_id GROUP BY technique)\n"

OBSERVED = """, ob AS (
  SELECT 'host' AS type, lower(trim(host)) AS value, host AS observed, source, sec, orig FROM ev WHERE host IS NOT NULL
  UNION ALL SELECT 'user', lower(CASE WHEN instr(trim("user"), '\\') > 0 THEN trim(substr(trim("user"), instr(trim("user"), '\\') + 1)) || '@' || trim(substr(trim("user"), 1, instr(trim("user"), '\\') - 1)) ELSE trim("user") END), "user", source, sec, orig FROM ev WHERE "user" IS NOT NULL
  UNION ALL SELECT 'ip', lower(src_ip), src_ip, source, sec, orig FROM ev WHERE src_ip IS NOT NULL
  UNION ALL SELECT 'ip', lower(dst_ip), dst_ip, source, sec, orig FROM ev WHERE dst_ip IS NOT NULL
  UNION ALL SELECT 'process', lower(process_name), process_name, source, sec, orig FROM ev WHERE process_name IS NOT NULL
  UNION ALL SELECT 'file', lower(file_path), file_path, source, sec, orig FROM ev WHERE file_path IS NOT NULL
  UNION ALL SELECT 'registry', lower(registry_key), registry_key, source, sec, orig FROM ev WHERE registry_key IS NOT NULL)
"""
ENTITY = f"SELECT type, value, string_agg(DISTINCT observed, ',' ORDER BY observed) AS observed_as, count(*) AS count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, {iso('min(sec) FILTER (WHERE orig IS NOT NULL)')} AS first_seen, {iso('max(sec) FILTER (WHERE orig IS NOT NULL)')} AS last_seen FROM ob"

INST = """, made AS (SELECT *, lower(trim(coalesce(host, ''))) AS h, trim(process_name) AS image, lower(trim(process_name)) AS img FROM ev WHERE source = 'sysmon' AND event_id = '1' AND process_id IS NOT NULL AND trim(coalesce(process_name, '')) <> ''),
inst AS (SELECT h, process_id AS pid, img, sec AS start, id AS first_id, parent_id AS parent_pid, parent_name AS parent_image, "user", n AS events FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY h, process_id, img) AS n FROM made WINDOW w AS (PARTITION BY h, process_id, img ORDER BY sec, id)) WHERE r = 1),
cand AS (SELECT c.first_id, p.first_id AS p, p.start AS ps FROM inst c JOIN inst p ON c.h = p.h AND c.parent_pid = p.pid AND p.start <= c.start AND p.first_id <> c.first_id),
par AS (SELECT i.first_id, i.start, arg_max(p, (ps, p)) AS parent_first_id, count(p) AS candidates, CASE WHEN count(p) > 1 THEN string_agg(CAST(p AS VARCHAR), ',' ORDER BY ps, p) END AS ambiguous FROM inst i LEFT JOIN cand c ON c.first_id = i.first_id GROUP BY i.first_id, i.start)
"""
ANC = (EV + INST).replace("WITH src", "WITH RECURSIVE src", 1) + """, anc(first_id, ancestor, depth, path) AS (
  SELECT first_id, parent_first_id, 1, [first_id, parent_first_id] FROM par WHERE parent_first_id IS NOT NULL
  UNION ALL SELECT a.first_id, p.parent_first_id, a.depth + 1, list_append(a.path, p.parent_first_id) FROM anc a JOIN par p ON p.first_id = a.ancestor WHERE p.parent_first_id IS NOT NULL AND NOT list_contains(a.path, p.parent_first_id))
"""

P = f""", p AS (SELECT id, source, event_id, process_id, parent_id, dst_ip, dst_port, sec AS s, orig IS NOT NULL AS timed, lower(trim(coalesce(host, ''))) AS h, {base('process_name')} AS img,
  lower(trim(replace(coalesce(file_path, ''), '/', '\\'))) AS path, {base('file_path')} AS file, {STARTED} AS started, {PERSISTS} AS persists, {TARGET} AS target FROM ev)
"""
LINKS = {
    "link_same_process": "SELECT a AS event_a, id AS event_b, 90 AS confidence FROM (SELECT id, s, lag(id) OVER w AS a, s - lag(s) OVER w AS g FROM p WHERE timed AND h <> '' AND process_id IS NOT NULL AND img <> '' WINDOW w AS (PARTITION BY h, process_id, img ORDER BY s, id)) WHERE g <= 900",
    "link_same_file": "SELECT x.id AS event_a, y.id AS event_b, 80 AS confidence FROM p x JOIN p y ON x.path = y.path AND (x.s, x.id) < (y.s, y.id) WHERE x.timed AND y.timed AND x.path <> ''",
    "link_prefetch": "SELECT x.id AS event_a, y.id AS event_b, 65 AS confidence FROM p x JOIN p y ON x.h = y.h AND x.img = y.img AND abs(x.s - y.s) <= 3600 WHERE x.timed AND y.timed AND x.source = 'prefetch' AND y.started AND x.img <> ''",
    "link_persistence": f"SELECT event_a, event_b, max(c) AS confidence FROM (SELECT x.id AS event_a, y.id AS event_b, CASE WHEN y.path <> '' AND lower(trim(replace(x.target, '/', '\\'))) = y.path THEN 80 ELSE 60 END AS c FROM p x JOIN p y ON x.h = y.h AND x.id <> y.id AND ({base('x.target')} = coalesce(nullif(y.img, ''), y.file) AND {base('x.target')} <> '') WHERE x.timed AND y.timed AND x.persists AND x.target <> '' AND (y.started OR y.source = 'prefetch') AND (y.img <> '' OR y.path <> '') UNION ALL SELECT x.id, y.id, 80 FROM p x JOIN p y ON x.h = y.h AND x.id <> y.id AND lower(trim(replace(x.target, '/', '\\'))) = y.path WHERE x.timed AND y.timed AND x.persists AND x.target <> '' AND y.path <> '' AND (y.started OR y.source = 'prefetch')) GROUP BY 1, 2",
    "link_download_exec": "SELECT n.id AS event_a, r.id AS event_b, max(CASE WHEN r.parent_id = n.process_id THEN 85 ELSE 70 END) AS confidence FROM p n JOIN p f ON n.h = f.h AND n.process_id = f.process_id AND n.img = f.img AND f.s BETWEEN n.s AND n.s + 900 JOIN p r ON r.h = f.h AND r.img = f.file AND r.s BETWEEN f.s AND f.s + 900 WHERE n.timed AND f.timed AND r.timed AND n.dst_ip IS NOT NULL AND n.h <> '' AND n.img <> '' AND f.source = 'sysmon' AND f.event_id = '11' AND f.file <> '' AND r.started GROUP BY 1, 2",
}
_KIND = {"link_same_process": "same-process", "link_same_file": "same-file", "link_prefetch": "same-file", "link_persistence": "persistence-execution", "link_download_exec": "download-execution"}
LINKED = P + ", lk0 AS (" + " UNION ALL ".join(f"SELECT '{_KIND[k]}' AS kind, {i} AS o, * FROM ({q})" for i, (k, q) in enumerate(LINKS.items())) + "), lk AS (SELECT kind, event_a, event_b, confidence FROM lk0 QUALIFY row_number() OVER (PARTITION BY kind, least(event_a, event_b), greatest(event_a, event_b) ORDER BY o, event_a, event_b, confidence) = 1)\n"
_CC = """, ed AS (SELECT DISTINCT a, b FROM (SELECT event_a AS a, event_b AS b FROM lk UNION ALL SELECT event_b, event_a FROM lk) WHERE a <> b),
mem(id, root) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM ed
  UNION (SELECT e.b, min(m.root) FROM mem m JOIN ed e ON e.a = m.id JOIN recurring.mem r ON r.id = e.b WHERE m.root < r.root GROUP BY e.b))
"""
CLUSTERED = (EV + LINKED).replace("WITH src", "WITH RECURSIVE src", 1) + _CC
ATTACHED = FINDINGS.replace("WITH src", "WITH RECURSIVE src", 1) + LINKED + _CC + """, fst AS (SELECT root, min((sec, ev.id)) AS f FROM mem JOIN ev ON ev.id = mem.id GROUP BY root),
held AS (SELECT rule_id, event_id, root, count(DISTINCT mem.id) AS n FROM (SELECT rule_id, event_id, unnest(string_split(evidence, ',')) AS x FROM fd) u JOIN mem ON CAST(x AS BIGINT) = mem.id GROUP BY ALL),
att AS (SELECT fd.rule_id, fd.event_id, severity, h.root FROM fd LEFT JOIN (SELECT rule_id, event_id, held.root FROM held JOIN fst ON fst.root = held.root QUALIFY row_number() OVER (PARTITION BY rule_id, event_id ORDER BY n DESC, f) = 1) h ON h.rule_id = fd.rule_id AND h.event_id = fd.event_id)
"""
RANKED = ATTACHED + f""", rk AS (SELECT c.root, c.events, coalesce(g.n, 0) AS findings, coalesce(g.w, -1) AS worst, f FROM (SELECT root, count(*) AS events FROM mem GROUP BY root) c JOIN fst ON fst.root = c.root LEFT JOIN (SELECT root, count(*) AS n, max({RANK}) AS w FROM att WHERE root IS NOT NULL GROUP BY root) g ON g.root = c.root),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY worst DESC, findings DESC, events DESC, f) - 1 AS BIGINT) AS cluster_id, root, CAST(events AS BIGINT) AS events, CAST(findings AS BIGINT) AS findings, CAST(worst AS INTEGER) AS worst FROM rk)
"""
EXECUTED = f"(SELECT {base('process_name')} FROM ev WHERE {STARTED} OR source = 'prefetch')"


def glob(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches(lower({column}), '(?s)^{pattern}$'), false)"


_PS, _OTHER = glob("process_name", r"power.*\.exe"), glob("parent_name", r"winword\.exe")
_CMD = f"({glob('command_line', '.*-enc .*')} OR {glob('command_line', '.*[d]ownload.tring.*')})"
_RULE_NEEDS = values([(r[0], s, i) for r in RULES for s, i in r[4]], "rule_id, source, event_id")


def _sample(where: str, level: str, confidence: int, technique: str) -> str:
    return EV + f"SELECT id AS event_id, '{level}' AS severity, CAST({confidence} AS INTEGER) AS confidence, '{technique}' AS techniques FROM ev WHERE {where}"


def _plain_flags(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{ENCODED_PARSER}') THEN 'encoded-command' ELSE '' END"


#: Log events as exports.py writes and reads them: every tenth process start as a script block, every tenth logon in another channel.
EXPORTED = """
, x AS (SELECT *, CASE WHEN source = 'sysmon' AND event_id = '1' AND id % 10 = 3 THEN 'powershell' WHEN source = 'sysmon' THEN 'sysmon' WHEN id % 10 = 7 THEN 'generic' ELSE 'security' END AS kind FROM ev WHERE source IN ('sysmon', 'evtx:Security'))
SELECT 'log-' || (id // 100) || '.{0}' AS source_file, CAST(row_number() OVER (PARTITION BY id // 100 ORDER BY id) - 1 AS INTEGER) AS record_index, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts,
  CASE kind WHEN 'security' THEN 'evtx:Security' WHEN 'generic' THEN 'evtx:Application' ELSE kind END AS source, CASE WHEN kind = 'powershell' THEN '4104' ELSE event_id END AS event_id, host,
  CASE WHEN kind IN ('sysmon', 'security') THEN "user" END AS "user", CASE WHEN kind = 'sysmon' THEN process_name END AS process_name, CASE WHEN kind = 'sysmon' THEN parent_name END AS parent_name,
  CASE WHEN kind IN ('sysmon', 'powershell') THEN command_line END AS command_line, CASE WHEN kind = 'sysmon' THEN process_id END AS process_id, CASE WHEN kind = 'sysmon' THEN parent_id END AS parent_id,
  CASE WHEN kind = 'security' THEN src_ip END AS src_ip, CASE WHEN kind = 'sysmon' THEN dst_ip END AS dst_ip, CASE WHEN kind = 'sysmon' THEN dst_port END AS dst_port,
  CASE WHEN kind = 'sysmon' THEN file_path END AS file_path, CASE WHEN kind = 'sysmon' THEN registry_key END AS registry_key FROM x
"""


def _queries() -> dict[str, str]:
    q = {
        "timeline_coverage": EV + f"SELECT source, count(*) AS events, {iso('min(sec)')} AS first, {iso('max(sec)')} AS last FROM ev GROUP BY source",
        "event_scan": EV + ROW,
        "hash_documents": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
        "evidence_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS evidence_id, count(*) AS copies FROM documents GROUP BY 1",
        "load_jsonl_counts": EV + "SELECT count(*) FILTER (WHERE id % 89 <> 0 AND id % 83 <> 0) AS good, count(*) FILTER (WHERE id % 89 = 0) AS bad FROM ev",
        "export_jsonl": EV + f"""SELECT id, CAST(json_object('record', json_object('command_line', command_line, 'event_id', event_id, 'host', host, 'id', id, 'process_name', process_name, 'source', source, 'timestamp', {iso('sec')}, 'timestamp_original', orig, 'user', "user"), 'record_type', 'event', 'schema', 'evtrail.export/1', 'tool', 'evtrail') AS VARCHAR) AS value FROM ev""",
        "techniques": f"SELECT technique, name, tactics, observable FROM {TECH}",
        "union_sources": EV + "SELECT source, count(*) AS n FROM (SELECT source FROM ev UNION ALL SELECT 'orders:' || o_orderstatus FROM orders UNION ALL SELECT 'lineitem:' || l_linestatus FROM lineitem) GROUP BY source",
        "events_query_host": EV + ROW + " WHERE lower(host) = 'ws-001'",
        "events_query_user": EV + ROW + " WHERE lower(\"user\") = 'corp\\admin-1'",
        "events_query_process": EV + ROW + " WHERE lower(process_name) = 'powershell.exe'",
        "events_query_eventid": EV + ROW + " WHERE event_id = '4625'",
        "events_query_keyword": EV + ROW + " WHERE lower(command_line) LIKE '%temp%payload_exe%' OR lower(file_path) LIKE '%temp%payload_exe%' OR lower(registry_key) LIKE '%temp%payload_exe%'",
        "events_query_page": EV + ROW + " WHERE lower(host) = 'ws-002' ORDER BY sec, id LIMIT 50 OFFSET 25",
        "events_query_after": EV + ROW + " WHERE lower(host) = 'ws-002' AND (sec, id) > (1704067200 + 7200, 10) ORDER BY sec, id LIMIT 50",
        "timeline_summary": EV + f"SELECT id, {SUMMARY} AS summary, orig IS NOT NULL AS timed FROM ev",
        "timeline_range": EV + f"SELECT id, {SUMMARY} AS summary FROM ev WHERE orig IS NOT NULL AND sec BETWEEN 1704067200 + 7200 AND 1704067200 + 14400",
        "timeline_source": EV + f"SELECT id, {SUMMARY} AS summary FROM ev WHERE lower(source) LIKE 'evtx%'",
        "timeline_highlights": EV + f"SELECT * FROM (SELECT 'first' AS \"end\", id, {SUMMARY} AS summary FROM ev WHERE orig IS NOT NULL ORDER BY sec, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'last', id, {SUMMARY} FROM ev WHERE orig IS NOT NULL ORDER BY sec DESC, id DESC LIMIT 10)",
        "event_summary": EV + f"SELECT id, {LINE} AS line FROM ev",
        "report_events": EV + f"SELECT id, {iso('sec')} AS ts, source, event_id, host, \"user\", process_name, process_id, file_path, registry_key, dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '?') AS dst FROM ev",
        "external_ips": EV + f"SELECT ip, {external('ip')} AS external, {external('ip')} AS external_loose FROM (SELECT DISTINCT ip FROM (SELECT dst_ip AS ip FROM ev WHERE dst_ip IS NOT NULL UNION ALL SELECT (c_custkey % 256) || '.' || (c_custkey * 7 % 256) || '.' || (c_custkey * 13 % 256) || '.' || (c_custkey * 31 % 256) FROM customer))",
        "persistence_targets": EV + f"SELECT id, {TARGET} AS target, {RULE_TARGET} AS rule_target FROM ev WHERE {PERSISTS}",
        "rules_list": f"SELECT * FROM {values([(r[0], r[1], r[2], ','.join(r[3])) for r in RULES], 'rule_id, severity, confidence, mitre')}",
        "rules_applicable": EV + f"SELECT DISTINCT t.rule_id FROM {_RULE_NEEDS} JOIN ev ON ev.source = t.source AND ev.event_id = t.event_id",
        "findings_by_severity": FINDINGS + "SELECT severity, count(*) AS n FROM fd GROUP BY severity",
        "findings_list": FINDINGS + "SELECT rule_id, severity, event_id FROM fd WHERE rule_id = 'EV-DET-RUNKEY' AND severity = 'high'",
        "findings_min_severity": FINDINGS + f"SELECT rule_id, severity, event_id FROM fd WHERE {RANK} >= 2",
        "findings_uid": FINDINGS + f"SELECT printf('EV-%04d', row_number() OVER (ORDER BY {RANK} DESC, rule_id, event_id, detail)) AS uid, rule_id, event_id FROM fd",
        "findings_csv_safe": FINDINGS + r"SELECT rule_id, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN regexp_matches(x, '^[=+\-@\t\r]') THEN '''' || x ELSE x END AS detail, replace(evidence, ',', ';') AS evidence FROM (SELECT *, ['=', '+', '-', '@', '', 'x'][event_id % 6 + 1] || detail AS x FROM fd)",
        "sigma_logsource": EV + "SELECT id AS event_id FROM ev WHERE source = 'sysmon' AND event_id IN ('12', '13', '14') AND process_name IS NOT NULL",
        "sigma_selection": EV + f"SELECT id AS event_id FROM ev WHERE ({glob('process_name', 'c.*[.]exe')} OR {glob('process_name', 'svchos.[.]exe')}) AND {glob('process_name', '.*[hm].*')}",
        "sigma_and_not": EV + f"SELECT id AS event_id FROM ev WHERE {_PS} AND NOT {_OTHER}",
        "sigma_one_of": EV + f"SELECT id AS event_id FROM ev WHERE {_PS} OR {_CMD}",
        "sigma_all_of": EV + f"SELECT id AS event_id FROM ev WHERE ({_PS} AND {_CMD}) OR ({_OTHER} AND NOT {_PS})",
        "sigma_encoded_ps": _sample(f"source = 'sysmon' AND event_id = '1' AND ({glob('process_name', '.*powershell[.]exe')} OR {glob('process_name', '.*pwsh[.]exe')}) AND ({glob('command_line', '.* -enc .*')} OR {glob('command_line', '.* -encodedcommand .*')} OR {glob('command_line', '.* -e .*')})", "high", 70, "T1059.001"),
        "sigma_office": _sample("source = 'sysmon' AND event_id = '1' AND regexp_matches(lower(parent_name), '(winword|excel|powerpnt|outlook)[.]exe$') AND regexp_matches(lower(process_name), '(cmd|powershell|wscript|mshta)[.]exe$')", "high", 70, "T1204.002"),
        "sigma_runkey": _sample(r"source = 'sysmon' AND event_id IN ('12', '13', '14') AND regexp_matches(lower(registry_key), '\\currentversion\\run(once)?\\')", "medium", 60, "T1547.001"),
        "sigma_rare_port": _sample("source = 'sysmon' AND event_id = '3' AND dst_port IN (4444, 8444, 1337, 31337)", "low", 45, "T1571"),
        "mitre_coverage": COVERED + f"SELECT cov.technique, name, CAST(n AS BIGINT) AS findings, rules FROM cov JOIN {TECH} ON t.technique = cov.technique",
        "mitre_gaps": COVERED + f"SELECT technique, name FROM {TECH} WHERE observable AND technique NOT IN (SELECT technique FROM cov)",
        "mitre_unobservable": f"SELECT technique, name FROM {TECH} WHERE NOT observable",
        "mitre_mapping_check": f"SELECT rule_id, technique FROM {RULE_TECH} WHERE technique NOT IN (SELECT technique FROM {TECH.replace('AS t(', 'AS u(')})",
        "top_techniques": COVERED + "SELECT technique, CAST(n AS BIGINT) AS findings FROM cov ORDER BY n DESC, technique LIMIT 10",
        "entities": EV + OBSERVED + ENTITY + " GROUP BY type, value",
        "entities_parts": EV + OBSERVED + ENTITY + " GROUP BY type, value",
        "coverage_parts": EV + f"SELECT source, count(*) AS events, {iso('min(sec)')} AS first, {iso('max(sec)')} AS last FROM ev GROUP BY source",
        "entities_hash": "SELECT 'hash' AS type, 'md5:' || md5(text) AS value, 'MD5:' || upper(md5(text)) AS observed_as, count(*) AS count, 'file' AS sources, CAST(NULL AS VARCHAR) AS first_seen, CAST(NULL AS VARCHAR) AS last_seen FROM documents WHERE text IS NOT NULL GROUP BY md5(text)",
        "lineage_instances": EV + INST + f'SELECT h, pid, img, {iso("start")} AS start, first_id, parent_pid, parent_image, "user", events FROM inst',
        "lineage_pid_reuse": EV + INST + "SELECT h, pid, count(DISTINCT img) AS images FROM inst GROUP BY h, pid HAVING count(DISTINCT img) > 1",
        "lineage_parents": EV + INST + "SELECT first_id, parent_first_id, candidates, ambiguous FROM par",
        "lineage_references": EV + INST + """SELECT first_id, count(*) AS "references" FROM (SELECT arg_max(i.first_id, (i.start, -i.first_id)) AS first_id FROM (SELECT *, lower(trim(coalesce(host, ''))) AS h FROM ev WHERE process_id IS NOT NULL AND NOT (source = 'sysmon' AND event_id = '1')) e JOIN inst i ON i.h = e.h AND i.pid = e.process_id AND (i.start, i.first_id) < (e.sec, e.id) GROUP BY e.id) GROUP BY first_id""",
        "lineage_orphans": EV + INST + "SELECT first_id FROM par WHERE candidates = 0",
        "lineage_roots": EV + INST + f"SELECT first_id, {iso('start')} AS start FROM par WHERE parent_first_id IS NULL",
        "lineage_tree": ANC + """, deep AS (SELECT first_id, max(depth) AS depth, arg_max(ancestor, depth) AS top FROM anc GROUP BY first_id)
SELECT CAST(coalesce(depth, 0) AS INTEGER) AS depth, repeat('  ', CAST(coalesce(depth, 0) AS BIGINT)) || img || ' (' || pid || ')' AS line
FROM inst LEFT JOIN deep ON deep.first_id = inst.first_id JOIN par ON par.first_id = coalesce(top, inst.first_id) WHERE par.parent_first_id IS NULL""",
        "findings_explained": EV + f"""SELECT 'EV-DET-TASK' AS rule_id, id AS event_id, 'Task in a writable folder' AS title, 'A task on ' || host || ' runs ' || file_path || '.' AS what, 'T1053.005' AS mitre FROM ev WHERE source = 'tasks' AND regexp_matches(file_path, '{WRITABLE}')
UNION ALL SELECT 'EV-DET-SVC', id, 'Service in a writable folder', 'A service on ' || host || ' runs ' || file_path || '.', 'T1543.003' FROM ev WHERE source = 'services' AND regexp_matches(file_path, '{WRITABLE}')""",
        "findings_cited": FINDINGS + f"""SELECT rule_id, '1' AS rule_version, fd.event_id, CAST(n - 1 AS INTEGER) AS n, ev.id AS cited, ev.source, ev.event_id AS source_event_id, {LINE.replace("event_id", "ev.event_id")} AS observation
FROM (SELECT rule_id, event_id, unnest(string_split(evidence, ',')) AS c, unnest(range(1, len(string_split(evidence, ',')) + 1)) AS n FROM fd WHERE rule_id IN ('EV-DET-BRUTE', 'EV-DET-OFFICE')) fd JOIN ev ON ev.id = CAST(c AS BIGINT)""",
        "process_creations": EV + f"SELECT id FROM ev WHERE {STARTED}",
        "writable_paths": EV + f"SELECT id, file_path FROM ev WHERE regexp_matches(file_path, '{WRITABLE}')",
        "executed_images": EV + f"SELECT DISTINCT {base('process_name')} AS image FROM ev WHERE ({STARTED} OR source = 'prefetch') AND {base('process_name')} <> ''",
        "jsonl_roundtrip": EV + ROW,
        "lineage_ancestors": ANC + "SELECT first_id, ancestor, depth FROM anc",
        "lineage_descendants": ANC + "SELECT ancestor, count(DISTINCT first_id) AS descendants FROM anc GROUP BY ancestor",
        "lineage_depth": ANC + "SELECT inst.first_id, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth FROM inst LEFT JOIN anc ON anc.first_id = inst.first_id GROUP BY inst.first_id",
        "lineage_focus": ANC + "SELECT first_id FROM inst WHERE contains(img, 'winword') UNION SELECT first_id FROM anc WHERE ancestor IN (SELECT first_id FROM inst WHERE contains(img, 'winword'))",
        "clusters": CLUSTERED + "SELECT id, root FROM mem",
        "clusters_grown": CLUSTERED + "SELECT id, root FROM mem",
        "correlate_stats": EV + LINKED + "SELECT kind, count(*) AS n FROM lk GROUP BY kind",
        "link_classes": EV + LINKED + f""", kp AS (SELECT h, id, lower(trim(replace(target, '/', '\\'))) AS tp, {base('target')} AS tb FROM p WHERE timed AND persists AND target <> ''),
rn AS (SELECT h, id, path, coalesce(nullif(img, ''), file) AS xb FROM p WHERE timed AND (started OR source = 'prefetch') AND (img <> '' OR path <> '')),
cls AS (
  SELECT kind, 'path' AS "by", CAST(NULL AS VARCHAR) AS h, path AS key, (SELECT count(*) FROM p y WHERE y.timed AND y.path = p.path) AS "left", NULL AS "right", count(*) AS links, 80 AS confidence, min((event_a, event_b)) AS f FROM lk JOIN p ON p.id = event_a WHERE kind = 'same-file' AND confidence = 80 GROUP BY kind, path
  UNION ALL SELECT kind, 'path', rn.h, path, count(DISTINCT event_a), count(DISTINCT event_b), count(*), 80, min((event_a, event_b)) FROM lk JOIN rn ON rn.id = event_b WHERE kind = 'persistence-execution' AND confidence = 80 GROUP BY kind, rn.h, path
  UNION ALL SELECT kind, 'name', rn.h, xb, (SELECT count(*) FROM kp WHERE kp.h = rn.h AND kp.tb = rn.xb), (SELECT count(*) FROM rn z WHERE z.h = rn.h AND z.xb = rn.xb), count(*), 60, min((event_a, event_b)) FROM lk JOIN rn ON rn.id = event_b WHERE kind = 'persistence-execution' AND confidence = 60 GROUP BY kind, rn.h, xb)
SELECT kind, "by", h, key, "left", coalesce("right", "left") AS "right", links, confidence, f[1] AS event_a, f[2] AS event_b FROM cls""",
        "cluster_confidence": CLUSTERED + "SELECT root, confidence, event_a, event_b, kind FROM (SELECT root, lk.*, row_number() OVER (PARTITION BY root ORDER BY confidence, event_a, event_b, kind) AS n FROM lk JOIN mem ON mem.id = event_a) WHERE n = 1",
        "cluster_entities": CLUSTERED + OBSERVED.replace("FROM ev", "FROM (SELECT ev.*, root FROM ev JOIN mem ON mem.id = ev.id)").replace(", orig", ", root AS cluster_id") + "SELECT cluster_id, type, value, count(*) AS count FROM ob GROUP BY ALL",
        "finding_cluster": ATTACHED + "SELECT rule_id, event_id, root FROM att",
        "cluster_severity": ATTACHED + f"SELECT root, CAST(max({RANK}) AS INTEGER) AS worst, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM att WHERE root IS NOT NULL GROUP BY root",
        "cluster_techniques": ATTACHED + f"SELECT DISTINCT root, x.technique, name FROM att JOIN {RULE_TECH.replace('AS t(', 'AS x(')} ON x.rule_id = att.rule_id JOIN {TECH} ON t.technique = x.technique WHERE root IS NOT NULL",
        "cluster_rank": RANKED + "SELECT cluster_id, root FROM ranked",
        "clusters_ranked": RANKED + "SELECT cluster_id, root, events, findings, worst FROM ranked",
        "narrative_observed": RANKED + f"SELECT ev.id, {LINE} AS line FROM ev JOIN mem ON mem.id = ev.id WHERE root = (SELECT root FROM ranked WHERE cluster_id = 0)",
        "missing_prefetch": EV + f"SELECT DISTINCT {base('process_name')} AS base FROM ev WHERE {STARTED} AND {base('process_name')} <> '' AND {base('process_name')} NOT IN (SELECT {base('process_name')} FROM ev WHERE source = 'prefetch')",
        "missing_persist": EV + f"SELECT DISTINCT {TARGET} AS target FROM ev WHERE {PERSISTS} AND {base(TARGET)} <> '' AND {base(TARGET)} NOT IN {EXECUTED}",
        "missing_file": EV + f"SELECT DISTINCT file_path FROM ev WHERE source = 'sysmon' AND event_id = '11' AND {base('file_path')} NOT IN {EXECUTED}",
        "missing_network": EV + f"SELECT n.id, n.dst_ip || ':' || coalesce(CAST(n.dst_port AS VARCHAR), '?') AS dst FROM ev n WHERE dst_ip IS NOT NULL AND {external('dst_ip')} AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.host = n.host AND o.sec BETWEEN n.sec AND n.sec + 900 AND o.orig IS NOT NULL AND (o.file_path IS NOT NULL OR (o.source = 'sysmon' AND o.event_id = '1')))",
        "report_parsers": EV + "SELECT split_part(source, ':', 1) AS parser, count(*) AS events FROM ev GROUP BY 1",
        "report_overview": EV + f"SELECT count(*) AS events, count(orig) AS timed, count(DISTINCT source) AS sources, count(DISTINCT host) AS hosts, {iso('min(sec) FILTER (WHERE orig IS NOT NULL)')} AS first, {iso('max(sec) FILTER (WHERE orig IS NOT NULL)')} AS last FROM ev",
        "case_list": EV + "SELECT host AS case_id, count(*) AS events, count(DISTINCT source) AS sources FROM ev GROUP BY host",
        "batch_summary": FINDINGS.replace(f"{IMAGES} ON image =", f"{IMAGES_BY_HOST} ON ih = ev.host AND image =") + "SELECT e.case_id, e.events, coalesce(f.n, 0) AS findings, " + ", ".join(f"coalesce(f.{x}, 0) AS {x}" for x in SEVERITIES) + " FROM (SELECT host AS case_id, count(*) AS events FROM ev GROUP BY host) e LEFT JOIN (SELECT host AS case_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in SEVERITIES) + " FROM fd JOIN ev ON ev.id = fd.event_id GROUP BY host) f ON f.case_id = e.case_id",
        "fn_basename": EV + r"SELECT id, " + base("file_path") + r" AS base, nullif(regexp_extract(trim(file_path), '[^\\/]*$', 0), '') AS parser_base FROM ev",
        "fn_norm_path": EV + "SELECT id, lower(coalesce(file_path, '')) AS path FROM ev",
        "fn_normalize_user": EV + "SELECT id, lower(split_part(\"user\", '\\', 2) || '@' || split_part(\"user\", '\\', 1)) AS user_norm, coalesce(contains(\"user\", 'admin-'), false) AS admin FROM ev",
        "fn_parse_hashes": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(2 AS INTEGER) AS n FROM documents",
        "fn_hash_json": "SELECT doc_id, '{\"md5\":\"' || md5(text) || '\"}' AS hashes FROM documents",
        "fn_parse_pid": "SELECT event_id AS id, CASE WHEN event_id % 4 < 2 AND event_id > 0 THEN event_id END AS pid FROM events",
        "fn_parse_port": "SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 AND event_id * 17 % 80000 <= 65535 THEN CAST(event_id * 17 % 80000 AS INTEGER) END AS port FROM events",
        "fn_normalize_ts": EV + f"SELECT id, CASE WHEN id % 7 < 6 THEN {iso('sec')} END AS ts FROM ev WHERE id < 10000000",
        "fn_filetime": EV + f"SELECT id, CASE WHEN id % 50 <> 0 THEN {iso('sec')} END AS ts FROM ev WHERE id < 10000000",
        "fn_encoded_flag": EV + f"SELECT id, {_plain_flags('command_line')} AS flags FROM ev WHERE command_line IS NOT NULL",
        "fn_excerpt": EV + "SELECT id, substr(concat_ws(' | ', process_name, command_line, file_path), 1, 300) AS excerpt FROM ev",
        "fn_exe_of": EV + rf"""SELECT id, coalesce(nullif(regexp_extract(command_line, '(?i)^\s*"?(.*?\.exe)', 1), ''), trim(replace(command_line, '"', ''))) AS cut, {TOKEN} AS first, {ANYWHERE} AS anywhere FROM ev WHERE command_line IS NOT NULL""",
        "fn_tags_to_techniques": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN length(substr(lpad(CAST(p_partkey AS VARCHAR), 3, '0'), 1, 3)) = 3 THEN 'T1' || substr(lpad(CAST(p_partkey AS VARCHAR), 3, '0'), 1, 3) END, CASE WHEN p_partkey IS NOT NULL THEN 'T1059.001' END], lambda x: x IS NOT NULL), ',') AS techniques FROM part",
        "fn_sanitize_case": r"SELECT p_partkey, substr(regexp_replace(regexp_replace(' /' || p_type || ': ' || p_name || '!', '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 64) AS case_name FROM part",
        "fn_qualified_user": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'CORP\\' || c_name ELSE c_name END AS who FROM customer",
        "fn_service_flags": EV + r"SELECT id, ['boot', 'system', 'auto', 'manual', 'disabled'][id % 5 + 1] AS start, concat_ws(',', CASE WHEN id % 5 = 2 THEN 'auto-start' END, CASE WHEN regexp_matches(file_path, '(?i)\\temp\\') THEN 'image-in-temp-dir' END, CASE WHEN contains(regexp_extract(file_path, '(?i)^(.*?\.exe)', 1), ' ') THEN 'unquoted-service-path' END) AS flags FROM ev WHERE source = 'services'",
    }
    q["ingest_event_xml"] = EV + EXPORTED.format("xml")
    at = "CAST(floor(s_suppkey / 50) AS BIGINT) AS n"
    q["registry_autoruns"] = f"SELECT {at}, 'Software\\Microsoft\\Windows\\CurrentVersion\\Run' AS key, s_name AS value, 'C:\\Temp\\' || s_name || '.exe' AS data, strftime(to_timestamp(133500000000000000 // 10000000 - 11644473600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS last_write FROM supplier"
    q["registry_subkeys"] = f"SELECT {at}, 'Software\\Vendor\\S' || s_suppkey AS key FROM supplier"
    q["registry_values"] = "".join(f"{'' if v == 'Tag' else ' UNION ALL '}SELECT {at}, 'Software\\Vendor\\S' || s_suppkey AS key, '{v}' AS value, '{k}' AS kind, CAST({c} AS VARCHAR) AS data FROM supplier" for v, k, c in (("Tag", "REG_SZ", "s_name || '/' || s_nationkey"), ("Nation", "REG_DWORD", "s_nationkey")))
    q["registry_key"] = f"SELECT * FROM ({q['registry_values']}) WHERE key = 'Software\\Vendor\\S7'"
    words = "(VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate(("enc", "temp", "download", "cmd.exe", "/q", "webclient"))) + ") AS v(word, n)"
    q["sigma_many"] = EV + f"""SELECT 'many-' || process_name || '-' || n AS rule_id, 'medium' AS severity, CAST(60 AS INTEGER) AS confidence, id AS event_id, 'T1059' AS techniques FROM ev, {words} WHERE source = 'sysmon' AND event_id = '1' AND contains(lower(command_line), word)
UNION ALL SELECT 'many-' || lower(host), 'medium', 60, id, '' FROM ev WHERE source = 'sysmon' AND event_id = '3' AND starts_with(host, 'WS-') AND NOT (dst_port IN (443, 80) OR regexp_matches(CAST(dst_port AS VARCHAR), '^8.8.$'))"""
    q["ingest_event_json"] = EV + EXPORTED.format("json")
    q["ingest_event_lines"] = EV + EXPORTED.format("jsonl")
    q["ingest_services"] = EV + """SELECT 'services-' || (id // 100) || '.json' AS source_file, CAST(row_number() OVER (PARTITION BY id // 100 ORDER BY id) - 1 AS INTEGER) AS record_index, source, event_id, 'LocalSystem' AS "user", process_name, '"' || file_path || '" -k run' AS command_line, file_path FROM ev WHERE source = 'services'"""
    q["ingest_tasks"] = EV + r"""SELECT 'task-' || id || '.xml' AS source_file, CAST(0 AS INTEGER) AS record_index, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts, source, event_id, 'CORP\svc' AS "user", split_part(file_path, '\', -1) AS process_name, file_path || ' /q' AS command_line, file_path FROM ev WHERE source = 'tasks'"""
    q["ingest_refused"] = "SELECT ['binary event log', 'malformed XML', 'unknown kind of file'][event_id % 3 + 1] AS fault, count(*) AS files FROM events GROUP BY 1"
    for kind in ("host", "user", "ip", "process", "file", "registry"):
        q[f"entities_{kind}"] = EV + OBSERVED + ENTITY + f" WHERE type = '{kind}' GROUP BY type, value"
    for rule, sql in DETECT.items():
        q["det_" + rule.removeprefix("EV-DET-").lower()] = EV + f"SELECT rule_id, severity, CAST(confidence AS INTEGER) AS confidence, event_id, detail, evidence FROM ({sql})"
    for link, sql in LINKS.items():
        q[link] = EV + P + f"SELECT event_a, event_b, CAST(confidence AS INTEGER) AS confidence FROM ({sql})"
    return q


SQL = _queries()
