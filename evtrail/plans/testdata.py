"""The driver's tables as normalized events: a fixed projection, the same in Spark and in SQL (survey 7.4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform

START = 1704067200
#: Fixed values of the projection.
IMAGES = ("powershell.exe", "cmd.exe", "winword.exe", "excel.exe", "chrome.exe", "svchost.exe", "payload.exe", "explorer.exe")
PARENTS = ("winword.exe", "explorer.exe", "excel.exe", "services.exe")
PORTS = (443, 4444, 80, 31337, 8080)
COMMANDS = ("powershell.exe -enc QUJD", '"C:\\Temp\\payload.exe" /q', 'powershell -c "IEX (New-Object Net.WebClient).DownloadString(1)"', "C:\\Windows\\System32\\cmd.exe /c dir")
SERVICE_DIRS = ("C:\\Temp\\", "C:\\Windows\\System32\\", "C:\\ProgramData\\Vendor\\", "C:\\Program Files\\Vendor\\")


def _pick(items: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at + 1).cast("int"))


def _host(n: Column) -> Column:
    return F.concat(F.lit("WS-"), F.lpad((n % 5).cast("string"), 3, "0"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, u, et = F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("event_type")
    e = raw.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), u.alias("u"), et.alias("et"), k.alias("k"))
    u, et, k = F.col("u"), F.col("et"), F.col("k")
    sec = (F.lit(START) + F.floor((F.col("s") - START) / 60)).cast("long")
    ran = et.isin("click", "view", "purchase")
    click, view, bought = et == "click", et == "view", et == "purchase"
    net = F.element_at(F.array(F.lit("8.8.8."), F.lit("10.1.2."), F.lit("203.0.113."), F.lit("45.33.32.")), (k % 4 + 1).cast("int"))
    ts = F.timestamp_seconds(sec)
    out = e.select(
        F.col("id"),
        ts.alias("timestamp"),
        F.when(F.col("id") % 97 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp_original"),
        F.when(ran, "sysmon").otherwise("evtx:Security").alias("source"),
        F.when(click & (k % 10 == 9), "13").when(click, "1").when(view, "3").when(bought, "11").when(et == "error", "4625").otherwise("4624").alias("event_id"),
        # A few connections are the only events of their host.
        F.when(view & (F.col("id") % 101 == 5), F.concat(F.lit("LONE-"), F.col("id").cast("string"))).otherwise(_host(u)).alias("host"),
        F.concat(F.when(u % 30 < 3, F.lit("CORP\\admin-")).otherwise(F.lit("CORP\\user")), (u % 30).cast("string")).alias("user"),
        F.when(ran, _pick(IMAGES, u % 8)).alias("process_name"),
        F.when(ran, 1000 + u % 35).alias("process_id"),
        F.when(click, _pick(PARENTS, k % 4)).alias("parent_name"),
        F.when(click, (1000 + (u * 7 + k) % 35).cast("long")).alias("parent_id"),
        F.when(click & (k % 10 != 9), _pick(COMMANDS, F.least(k % 6, F.lit(3)))).alias("command_line"),
        F.when(et == "error", F.concat(F.lit("10.0.0."), (u % 30 % 7).cast("string"))).when(et == "signup", F.concat(F.lit("10.0.0."), (k % 8).cast("string"))).alias("src_ip"),
        F.when(view, F.concat(net, k.cast("string"))).alias("dst_ip"),
        F.when(view, _pick(PORTS, k % 5)).cast("int").alias("dst_port"),
        F.when(bought, F.concat(F.lit("C:\\Users\\u"), (u % 30).cast("string"), F.lit("\\AppData\\Local\\Temp\\"), F.when(F.col("id") % 53 == 7, F.concat(F.lit("kept"), (F.col("id") % 11).cast("string"), F.lit(".dat"))).otherwise(_pick(IMAGES, k % 8)))).alias("file_path"),
        F.when(click & (k % 10 == 9), F.concat(F.lit("HKU\\S-1\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\v"), k.cast("string"))).alias("registry_key"),
        # What a parent ran is no command of the process itself.
        F.when(click & (k % 10 != 9), F.concat(F.lit("ParentCommandLine="), _pick(("IWR -Uri x", "wget.exe y", "notepad"), F.col("id") % 3))).alias("raw"),
    )
    return conform(out)


def _artifact(rows: DataFrame, key: str, first: int, step: int, source: str, event_id: str, untimed: Column, **columns: Column) -> DataFrame:
    n = F.col(key).cast("long")
    ts = F.timestamp_seconds(F.lit(START) + n * step)
    return conform(
        rows.select(
            (n + first).alias("id"),
            ts.alias("timestamp"),
            F.when(~untimed, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp_original"),
            F.lit(source).alias("source"),
            F.lit(event_id).alias("event_id"),
            _host(n).alias("host"),
            *[c.alias(name) for name, c in columns.items()],
        )
    )


def artifact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    p, s, c, n = (F.col(x).cast("long") for x in ("p_partkey", "s_suppkey", "c_custkey", "n_nationkey"))
    image = F.upper(_pick(IMAGES[:6], c % 6))
    parts = [
        _artifact(read("part"), "p_partkey", 10_000_000, 200, "services", "service", p % 7 == 0, file_path=F.concat(_pick(SERVICE_DIRS, p % 4), _pick(IMAGES, p % 8)), process_name=_pick(IMAGES, p % 8)),
        _artifact(read("supplier"), "s_suppkey", 20_000_000, 400, "tasks", "task", s % 5 == 0, file_path=F.concat(_pick(SERVICE_DIRS[:2], s % 2), _pick(IMAGES, s % 8))),
        _artifact(read("customer"), "c_custkey", 30_000_000, 280, "prefetch", "prefetch", F.lit(False), file_path=F.concat(F.lit("C:\\WINDOWS\\PREFETCH\\"), image, F.lit("-"), c.cast("string"), F.lit(".pf")), process_name=image),
        _artifact(read("nation"), "n_nationkey", 40_000_000, 1700, "registry", "run-key", F.lit(False), file_path=F.when(n % 3 == 0, F.concat(F.lit("C:\\Temp\\evil"), n.cast("string"), F.lit(".exe"))).otherwise(F.concat(F.lit("C:\\Users\\u1\\AppData\\Roaming\\"), _pick(IMAGES, n % 8)))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).unionByName(artifact_events(spark, sf_dir))


def _list(items: tuple) -> str:
    return "[" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in items) + "]"


_ISO = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


def _artifact_sql(table: str, key: str, first: int, step: int, source: str, event_id: str, untimed: str, process: str, path: str) -> str:
    sec = f"({START} + {key} * {step})"
    return f"""SELECT {first} + {key}, CAST({sec} AS BIGINT), CASE WHEN NOT ({untimed}) THEN {_ISO.format(sec)} END, '{source}', '{event_id}',
  'WS-' || lpad(CAST({key} % 5 AS VARCHAR), 3, '0'), NULL, {process}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {path}, NULL, NULL FROM {table}"""


#: The same rows in DuckDB: a common table expression ev, with the time in seconds (sec) and timestamp_original as orig.
EV = f"""
WITH src AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s, user_id AS u, event_type AS et, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT *, CAST({START} + floor((s - {START}) / 60.0) AS BIGINT) AS sec FROM src),
ev AS (
SELECT id, sec, CASE WHEN id % 97 <> 0 THEN {_ISO.format('sec')} END AS orig,
  CASE WHEN et IN ('click', 'view', 'purchase') THEN 'sysmon' ELSE 'evtx:Security' END AS source,
  CASE WHEN et = 'click' AND k % 10 = 9 THEN '13' WHEN et = 'click' THEN '1' WHEN et = 'view' THEN '3' WHEN et = 'purchase' THEN '11' WHEN et = 'error' THEN '4625' ELSE '4624' END AS event_id,
  CASE WHEN et = 'view' AND id % 101 = 5 THEN 'LONE-' || id ELSE 'WS-' || lpad(CAST(u % 5 AS VARCHAR), 3, '0') END AS host,
  CASE WHEN u % 30 < 3 THEN 'CORP\\admin-' ELSE 'CORP\\user' END || (u % 30) AS "user",
  CASE WHEN et IN ('click', 'view', 'purchase') THEN {_list(IMAGES)}[u % 8 + 1] END AS process_name,
  CASE WHEN et IN ('click', 'view', 'purchase') THEN 1000 + u % 35 END AS process_id,
  CASE WHEN et = 'click' THEN {_list(PARENTS)}[k % 4 + 1] END AS parent_name,
  CASE WHEN et = 'click' THEN 1000 + (u * 7 + k) % 35 END AS parent_id,
  CASE WHEN et = 'click' AND k % 10 <> 9 THEN {_list(COMMANDS)}[least(k % 6, 3) + 1] END AS command_line,
  CASE WHEN et = 'error' THEN '10.0.0.' || (u % 30 % 7) WHEN et = 'signup' THEN '10.0.0.' || (k % 8) END AS src_ip,
  CASE WHEN et = 'view' THEN ['8.8.8.', '10.1.2.', '203.0.113.', '45.33.32.'][k % 4 + 1] || k END AS dst_ip,
  CASE WHEN et = 'view' THEN {_list(PORTS)}[k % 5 + 1] END AS dst_port,
  CASE WHEN et = 'purchase' THEN 'C:\\Users\\u' || (u % 30) || '\\AppData\\Local\\Temp\\' || CASE WHEN id % 53 = 7 THEN 'kept' || (id % 11) || '.dat' ELSE {_list(IMAGES)}[k % 8 + 1] END END AS file_path,
  CASE WHEN et = 'click' AND k % 10 = 9 THEN 'HKU\\S-1\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\v' || k END AS registry_key,
  CASE WHEN et = 'click' AND k % 10 <> 9 THEN 'ParentCommandLine=' || ['IWR -Uri x', 'wget.exe y', 'notepad'][id % 3 + 1] END AS raw
FROM log
UNION ALL {_artifact_sql('part', 'p_partkey', 10_000_000, 200, 'services', 'service', 'p_partkey % 7 = 0', f"{_list(IMAGES)}[p_partkey % 8 + 1]", f"{_list(SERVICE_DIRS)}[p_partkey % 4 + 1] || {_list(IMAGES)}[p_partkey % 8 + 1]")}
UNION ALL {_artifact_sql('supplier', 's_suppkey', 20_000_000, 400, 'tasks', 'task', 's_suppkey % 5 = 0', 'NULL', f"{_list(SERVICE_DIRS[:2])}[s_suppkey % 2 + 1] || {_list(IMAGES)}[s_suppkey % 8 + 1]")}
UNION ALL {_artifact_sql('customer', 'c_custkey', 30_000_000, 280, 'prefetch', 'prefetch', 'false', f"upper({_list(IMAGES[:6])}[c_custkey % 6 + 1])", f"'C:\\WINDOWS\\PREFETCH\\' || upper({_list(IMAGES[:6])}[c_custkey % 6 + 1]) || '-' || c_custkey || '.pf'")}
UNION ALL {_artifact_sql('nation', 'CAST(n_nationkey AS BIGINT)', 40_000_000, 1700, 'registry', 'run-key', 'false', 'NULL', f"CASE WHEN n_nationkey % 3 = 0 THEN 'C:\\Temp\\evil' || n_nationkey || '.exe' ELSE 'C:\\Users\\u1\\AppData\\Roaming\\' || {_list(IMAGES)}[n_nationkey % 8 + 1] END")}
)
"""
