"""One query for each operator of the survey that SQL can express, over the projection in testdata.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import batch
from ..functions import scalars as S
from ..functions.network import external
from ..operators import attack, correlate, entities, growth, lineage, query, rules, sigma, summaries
from ..schema import SEVERITIES, iso, severity_rank
from ..sources import records
from ..tables import written
from . import exports
from .testdata import IMAGES, events, log_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _add(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame) -> DataFrame:
    """Flat event columns, with times as text."""
    return df.select("id", iso(F.col("timestamp")).alias("ts"), "source", "event_id", "host", "user", "process_name")


# scans, sources and sinks
@_add("timeline_coverage")
def _(s: SparkSession, d: str) -> DataFrame:
    return query.coverage(events(s, d))


@_add("event_scan")
def _(s: SparkSession, d: str) -> DataFrame:
    return _rows(query.order(events(s, d)))


@_add("hash_documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@_add("evidence_dedup")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("evidence_id"), F.count("*").alias("copies"))


@_add("load_jsonl_counts")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("id", iso(F.col("timestamp")).alias("timestamp"), "source", "event_id", "process_id")
    lines = e.select(F.when(F.col("id") % 89 == 0, "{bad").when(F.col("id") % 83 == 0, " ").otherwise(F.to_json(F.struct("*"))).alias("value"))
    return records.parse_jsonl(lines).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))


@_add("export_jsonl")
def _(s: SparkSession, d: str) -> DataFrame:
    return records.export_lines(events(s, d), "event", records.EXPORTED)


QUERIES |= {"ingest_event_xml": exports.event_xml, "ingest_event_json": exports.event_json, "ingest_event_lines": exports.event_lines, "ingest_services": exports.services, "ingest_tasks": exports.tasks, "ingest_refused": exports.refused}
QUERIES |= {f.__name__: f for f in (exports.registry_autoruns, exports.registry_key, exports.registry_subkeys, exports.registry_values)}


@_add("techniques")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.techniques(s)


@_add("union_sources")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("source")
    o = _table(s, d, "orders").select(F.concat(F.lit("orders:"), "o_orderstatus").alias("source"))
    li = _table(s, d, "lineitem").select(F.concat(F.lit("lineitem:"), "l_linestatus").alias("source"))
    return e.unionByName(o).unionByName(li).groupBy("source").agg(F.count("*").alias("n"))


# event query and timeline
for _name, _where in {
    "events_query_host": {"host": "ws-001"},
    "events_query_user": {"user": "corp\\ADMIN-1"},
    "events_query_process": {"process": "PowerShell.exe"},
    "events_query_eventid": {"event_id": "4625"},
    "events_query_keyword": {"keyword": "temp%payload_exe"},
}.items():
    QUERIES[_name] = lambda s, d, w=_where: _rows(query.events_where(events(s, d), **w))


@_add("events_query_page")
def _(s: SparkSession, d: str) -> DataFrame:
    return _rows(query.page(query.events_where(events(s, d), host="WS-002"), 50, 25))


@_add("timeline_summary")
def _(s: SparkSession, d: str) -> DataFrame:
    return query.timeline(events(s, d)).select("id", "summary", "timed")


@_add("timeline_range")
def _(s: SparkSession, d: str) -> DataFrame:
    return query.timeline(events(s, d), "2024-01-01T02:00:00Z", "2024-01-01T04:00:00Z").select("id", "summary")


@_add("timeline_source")
def _(s: SparkSession, d: str) -> DataFrame:
    return query.timeline(events(s, d), source="EVTX").select("id", "summary")


@_add("timeline_highlights")
def _(s: SparkSession, d: str) -> DataFrame:
    return query.highlights(events(s, d)).select("end", "id", "summary")


@_add("event_summary")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", query.event_line().alias("line"))


@_add("report_events")
def _(s: SparkSession, d: str) -> DataFrame:
    dst = F.concat(F.col("dst_ip"), F.lit(":"), F.coalesce(F.col("dst_port").cast("string"), F.lit("?")))
    return events(s, d).select("id", iso(F.col("timestamp")).alias("ts"), "source", "event_id", "host", "user", "process_name", "process_id", "file_path", "registry_key", dst.alias("dst"))


@_add("external_ips")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    made = _table(s, d, "customer").select(F.concat_ws(".", *[(k * m % 256).cast("string") for m in (1, 7, 13, 31)]).alias("ip"))
    own = events(s, d).select(F.col("dst_ip").alias("ip")).filter("ip IS NOT NULL").unionByName(made).distinct()
    return own.select("ip", external(F.col("ip")).alias("external"), external(F.col("ip"), strict=False).alias("external_loose"))


@_add("persistence_targets")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter(correlate.persistence()).select("id", correlate.target().alias("target"), rules.rule_target().alias("rule_target"))


# rules
for _rule in rules.RULES:
    QUERIES["det_" + _rule.id.removeprefix("EV-DET-").lower()] = lambda s, d, r=_rule: r.findings(events(s, d)).select("rule_id", "severity", "confidence", "event_id", "detail", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def _findings(s: SparkSession, d: str) -> DataFrame:
    return rules.detect(events(s, d))


@_add("rules_list")
def _(s: SparkSession, d: str) -> DataFrame:
    return rules.catalog(s).select("rule_id", "severity", "confidence", F.array_join("mitre", ",").alias("mitre"))


@_add("rules_applicable")
def _(s: SparkSession, d: str) -> DataFrame:
    return rules.applicable(events(s, d))


@_add("findings_by_severity")
def _(s: SparkSession, d: str) -> DataFrame:
    return _findings(s, d).groupBy("severity").agg(F.count("*").alias("n"))


@_add("findings_list")
def _(s: SparkSession, d: str) -> DataFrame:
    return _findings(s, d).filter((F.col("rule_id") == "EV-DET-RUNKEY") & (F.col("severity") == "high")).select("rule_id", "severity", "event_id")


@_add("findings_min_severity")
def _(s: SparkSession, d: str) -> DataFrame:
    return rules.detect(events(s, d), at_least="medium").select("rule_id", "severity", "event_id")


@_add("findings_uid")
def _(s: SparkSession, d: str) -> DataFrame:
    return rules.numbered(_findings(s, d)).select("uid", "rule_id", "event_id")


@_add("findings_csv_safe")
def _(s: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "", "x"))), (F.col("event_id") % 6 + 1).cast("int")), F.col("detail"))
    return records.safe_csv(_findings(s, d).select("rule_id", "event_id", odd.alias("detail"), "evidence"))


@_add("findings_explained")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    told = rules.explained(rules.detect(e, ["EV-DET-TASK", "EV-DET-SVC"]), e)
    return told.select("rule_id", "event_id", "title", "what", F.array_join("mitre", ",").alias("mitre"))


@_add("findings_cited")
def _(s: SparkSession, d: str) -> DataFrame:
    """What each event that a finding cites shows, in the finding's order."""
    e = events(s, d)
    told = rules.explained(rules.detect(e, ["EV-DET-BRUTE", "EV-DET-OFFICE"]), e)
    return told.select("rule_id", "rule_version", "event_id", F.posexplode("evidence_refs").alias("n", "r")).select("rule_id", "rule_version", "event_id", "n", F.col("r.event_id").alias("cited"), "r.source", "r.source_event_id", "r.observation")


@_add("process_creations")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter(rules.started()).select("id")


@_add("writable_paths")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter(F.col("file_path").rlike(S.WRITABLE)).select("id", "file_path")


@_add("executed_images")
def _(s: SparkSession, d: str) -> DataFrame:
    return rules.executed(events(s, d))


@_add("jsonl_roundtrip")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    line = F.to_json(F.struct("id", iso(F.col("timestamp")).alias("timestamp"), "source", "event_id", "host", "user", "process_name"))
    return _rows(records.parse_jsonl(e.select(line.alias("value"))).filter("error IS NULL"))


# sigma
_BASE = {"title": "q", "id": "q", "level": "medium"}
_SELECTIONS = {"sel_ps": {"Image": "power*.exe"}, "sel_cmd": {"CommandLine": ["*-enc *", "*[dD]ownload?tring*"]}, "other": {"ParentImage": "winword.exe"}}


def _sigma(condition: str, selections: dict | None = None, source: dict | None = None) -> Query:
    rule = sigma.load(_BASE | {"logsource": source or {}, "detection": (selections or _SELECTIONS) | {"condition": condition}})
    return lambda s, d: sigma.run(events(s, d), rule).select("event_id")


QUERIES |= {
    "sigma_logsource": _sigma("a", {"a": {"Image": "*"}}, {"category": "registry_event"}),
    "sigma_selection": _sigma("a", {"a": {"Image": ["c*.exe", "svchos?.exe"], "ProcessName": "*[hm]*"}}),
    "sigma_and_not": _sigma("sel_ps and not other"),
    "sigma_one_of": _sigma("1 of sel_*"),
    "sigma_all_of": _sigma("all of sel_* or other and not sel_ps"),
}
for _name, _spec in zip(("sigma_encoded_ps", "sigma_office", "sigma_runkey", "sigma_rare_port"), sigma.SAMPLES, strict=True):
    QUERIES[_name] = lambda s, d, r=_spec: sigma.run(events(s, d), sigma.load(r)).select("event_id", "severity", "confidence", "techniques")


@_add("sigma_many")
def _(s: SparkSession, d: str) -> DataFrame:
    """A rule for each image and word, and one for each host that names what isn't wanted."""
    rules_ = [
        sigma.load(_BASE | {"id": f"many-{image}-{i}", "logsource": {"category": "process_creation"}, "tags": ["attack.t1059"], "detection": {"a": {"Image": image}, "b": {"CommandLine": f"*{word}*"}, "condition": "a and b"}})
        for image in IMAGES
        for i, word in enumerate(("enc", "temp", "download", "cmd.exe", "/q", "webclient"))
    ]
    rules_ += [sigma.load(_BASE | {"id": f"many-ws-00{i}", "logsource": {"category": "network_connection"}, "detection": {"a": {"DestinationPort": [443, 80, "8?8?"]}, "b": {"ComputerName": f"ws-00{i}"}, "condition": "b and not a"}}) for i in range(5)]
    return sigma.run_all(events(s, d), rules_)


# ATT&CK
@_add("mitre_coverage")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.coverage(_findings(s, d))


@_add("mitre_gaps")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.gaps(_findings(s, d))


@_add("mitre_unobservable")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.unobservable(s)


@_add("mitre_mapping_check")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.mapping_faults(s)


@_add("top_techniques")
def _(s: SparkSession, d: str) -> DataFrame:
    return attack.top_techniques(_findings(s, d))


# entities
def _flat(df: DataFrame) -> DataFrame:
    return df.select("type", "value", F.array_join("observed_as", ",").alias("observed_as"), "count", F.array_join("sources", ",").alias("sources"), "first_seen", "last_seen")


QUERIES["entities"] = lambda s, d: _flat(entities.entities(events(s, d)))
# In four parts by id, merged.
QUERIES["entities_parts"] = lambda s, d: _flat(summaries.entities(summaries.entity_part(events(s, d).withColumn("part", F.col("id") % 4), "part")))
QUERIES["coverage_parts"] = lambda s, d: summaries.coverage(summaries.coverage_part(events(s, d).withColumn("part", F.col("id") % 4), "part"))
for _kind in ("host", "user", "ip", "process", "file", "registry"):
    QUERIES[f"entities_{_kind}"] = lambda s, d, k=_kind: _flat(entities.entities(events(s, d), k))


@_add("entities_hash")
def _(s: SparkSession, d: str) -> DataFrame:
    from ..schema import conform

    docs = _table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("file").alias("source"), F.create_map(F.lit("MD5"), F.upper(F.md5("text"))).alias("hashes"))
    return _flat(entities.entities(conform(docs), "hash"))


# lineage
def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inst = written(lineage.instances(events(s, d)))
    return inst, written(lineage.parents(inst))


@_add("lineage_instances")
def _(s: SparkSession, d: str) -> DataFrame:
    inst = lineage.instances(events(s, d))
    return inst.select("h", "pid", "img", iso(F.col("start")).alias("start"), "first_id", "parent_pid", "parent_image", "user", "events")


@_add("lineage_pid_reuse")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.pid_reuse(lineage.instances(events(s, d)))


@_add("lineage_parents")
def _(s: SparkSession, d: str) -> DataFrame:
    p = lineage.parents(lineage.instances(events(s, d)), ambiguous=True)
    return p.select("first_id", "parent_first_id", "candidates", F.array_join(F.col("ambiguous").cast("array<string>"), ",").alias("ambiguous"))


@_add("lineage_references")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return lineage.references(e, lineage.instances(e))


@_add("lineage_orphans")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.parents(lineage.instances(events(s, d))).filter("candidates = 0").select("first_id")


@_add("lineage_roots")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.parents(lineage.instances(events(s, d))).filter("parent_first_id IS NULL").select("first_id", iso(F.col("start")).alias("start"))


@_add("lineage_ancestors")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.ancestors(_tree(s, d)[1])


@_add("lineage_descendants")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.descendants(*_tree(s, d))


@_add("lineage_depth")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.depths(*_tree(s, d))


@_add("lineage_focus")
def _(s: SparkSession, d: str) -> DataFrame:
    inst, links = _tree(s, d)
    return lineage.focused(inst, links, inst.filter(F.col("img").contains("winword")).select("first_id"))


@_add("lineage_tree")
def _(s: SparkSession, d: str) -> DataFrame:
    return lineage.tree_rows(*_tree(s, d)).select("depth", "line")


# correlation
def _links(name: str) -> Query:
    return lambda s, d: getattr(correlate, name)(correlate.prepared(events(s, d))).select("event_a", "event_b", "confidence")


QUERIES |= {"link_same_process": _links("same_process"), "link_same_file": _links("same_file"), "link_prefetch": _links("prefetch"), "link_persistence": _links("persistence_execution"), "link_download_exec": _links("download_execution")}


def _classes(e: DataFrame) -> DataFrame:
    return correlate.link_classes(written(correlate.prepared(e)))


@_add("clusters")
def _(s: SparkSession, d: str) -> DataFrame:
    return correlate.clusters(events(s, d))


@_add("clusters_grown")
def _(s: SparkSession, d: str) -> DataFrame:
    """All events in two appends, of which each has every host and time."""
    own = events(s, d)
    odd = F.coalesce(F.col("id") % 2 == 1, F.lit(False))
    labels, hubs = s.createDataFrame([], growth.LABELS), s.createDataFrame([], growth.HUBS)
    labels, hubs = growth.grow(own.limit(0), labels, hubs, own.filter(odd))
    return growth.grow(own.filter(odd), labels, hubs, own.filter(~odd))[0]


@_add("events_query_after")
def _(s: SparkSession, d: str) -> DataFrame:
    return _rows(query.page_after(query.events_where(events(s, d), host="WS-002"), ("2024-01-01T02:00:00Z", 10), 50))


@_add("correlate_stats")
def _(s: SparkSession, d: str) -> DataFrame:
    return correlate.stats(_classes(events(s, d)))


@_add("link_classes")
def _(s: SparkSession, d: str) -> DataFrame:
    return _classes(events(s, d)).filter("by IN ('path', 'name')").select(*correlate.CLASS)


@_add("cluster_confidence")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return correlate.confidence(_classes(e), correlate.clusters(e))


@_add("cluster_entities")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return entities.cluster_entities(correlate.clusters(e).withColumnRenamed("root", "cluster_id"), e)


@_add("finding_cluster")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return correlate.attached(rules.detect(e), correlate.clusters(e), e).select("rule_id", "event_id", "root")


@_add("cluster_severity")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    own = correlate.attached(rules.detect(e), correlate.clusters(e), e).filter("root IS NOT NULL")
    return own.groupBy("root").agg(F.max(severity_rank(F.col("severity"))).alias("worst"), *[F.count_if(F.col("severity") == x).alias(x) for x in SEVERITIES])


@_add("cluster_techniques")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    own = correlate.attached(rules.detect(e), correlate.clusters(e), e).filter("root IS NOT NULL").select("root", "rule_id").distinct()
    tech = own.join(F.broadcast(rules.catalog(s).select("rule_id", F.explode("mitre").alias("technique"))), "rule_id")
    return tech.select("root", "technique").distinct().join(F.broadcast(attack.techniques(s).select("technique", "name")), "technique").select("root", "technique", "name")


@_add("cluster_rank")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return correlate.ranked(e, rules.detect(e), correlate.clusters(e)).select("cluster_id", "root")


@_add("clusters_ranked")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return correlate.ranked(e, rules.detect(e), correlate.clusters(e))


@_add("narrative_observed")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    members = correlate.clusters(e)
    top = correlate.ranked(e, rules.detect(e), members).filter("cluster_id = 0").select("root")
    return e.join(members.join(top, "root", "left_semi"), "id").select("id", query.event_line().alias("line"))


for _name in ("missing_prefetch", "missing_persist", "missing_network", "missing_file"):
    QUERIES[_name] = lambda s, d, n=_name: getattr(correlate, n)(events(s, d))


# reports
@_add("report_parsers")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(F.substring_index("source", ":", 1).alias("parser")).agg(F.count("*").alias("events"))


@_add("report_overview")
def _(s: SparkSession, d: str) -> DataFrame:
    t = F.when(query.timed(), F.col("timestamp"))
    return events(s, d).agg(F.count("*").alias("events"), F.count(t).alias("timed"), F.count_distinct("source").alias("sources"), F.count_distinct("host").alias("hosts"), iso(F.min(t)).alias("first"), iso(F.max(t)).alias("last"))


@_add("case_list")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(F.col("host").alias("case_id")).agg(F.count("*").alias("events"), F.count_distinct("source").alias("sources"))


@_add("batch_summary")
def _(s: SparkSession, d: str) -> DataFrame:
    """Each host's events as a case of its own."""
    e = written(events(s, d).withColumn("case_id", F.col("host")))
    return batch.counted(e, rules.detect(e, by=batch.CASE))


# scalar functions
@_add("fn_basename")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", S.basename(F.col("file_path")).alias("base"), S.parser_basename(F.col("file_path")).alias("parser_base"))


@_add("fn_norm_path")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", S.norm_path(F.concat(F.lit(" "), F.translate("file_path", "\\", "/"))).alias("path"))


@_add("fn_normalize_user")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", S.normalize_user(F.col("user")).alias("user_norm"), S.admin_like(F.col("user")).alias("admin"))


@_add("fn_parse_hashes")
def _(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("MD5="), F.md5("text"), F.lit(", SHA256 ="), F.sha2("text", 256), F.lit(",junk,X="))
    m = S.parse_hashes(text)
    return _table(s, d, "documents").select("doc_id", F.element_at(m, "md5").alias("md5"), F.element_at(m, "sha256").alias("sha256"), F.size(m).alias("n"))


@_add("fn_hash_json")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.to_json(F.create_map(F.lit("md5"), F.md5("text"))).alias("hashes"))


@_add("fn_parse_pid")
def _(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    text = F.when(i % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex("id")))).when(i % 4 == 1, F.concat(F.lit(" "), i.cast("string"))).when(i % 4 == 2, "-").otherwise(F.concat(F.lit("p"), i.cast("string")))
    return log_events(s, d).select("id", S.parse_pid(text).alias("pid"))


@_add("fn_parse_port")
def _(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("id") % 5 == 0, "http").otherwise((F.col("id") * 17 % 80000).cast("string"))
    return log_events(s, d).select("id", S.parse_port(text).alias("port"))


@_add("fn_normalize_ts")
def _(s: SparkSession, d: str) -> DataFrame:
    t, i = F.col("timestamp"), F.col("id")
    form = lambda f, c=t: F.date_format(c, f)
    text = (
        F.when(i % 7 == 0, iso(t))
        .when(i % 7 == 1, F.concat(form("yyyy-MM-dd'T'HH:mm:ss", t + F.expr("INTERVAL 2 HOURS")), F.lit("+02:00")))
        .when(i % 7 == 2, form("yyyy-MM-dd HH:mm:ss"))
        .when(i % 7 == 3, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".9876543Z")))
        .when(i % 7 == 4, form("MM/dd/yyyy HH:mm:ss"))
        .when(i % 7 == 5, form("yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.lit("2026"))
    )
    return log_events(s, d).select("id", iso(S.normalize_timestamp(text)).alias("ts"))


@_add("fn_filetime")
def _(s: SparkSession, d: str) -> DataFrame:
    ft = F.when(F.col("id") % 50 == 0, F.lit(0).cast("long")).otherwise((F.unix_timestamp("timestamp") + 11644473600) * 10000000 + 1234567)
    return log_events(s, d).select("id", iso(S.filetime(ft)).alias("ts"))


@_add("fn_encoded_flag")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter("command_line IS NOT NULL").select("id", F.array_join(S.encoded_flag(F.col("command_line")), ",").alias("flags"))


@_add("fn_excerpt")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("id", S.excerpt(F.col("process_name"), F.col("command_line"), F.col("file_path")).alias("excerpt"))


@_add("fn_exe_of")
def _(s: SparkSession, d: str) -> DataFrame:
    c = F.col("command_line")
    return events(s, d).filter(c.isNotNull()).select("id", S.exe_until_suffix(c).alias("cut"), S.exe_first_token(c).alias("first"), S.exe_anywhere(c).alias("anywhere"))


@_add("fn_tags_to_techniques")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    tags = F.array(F.concat(F.lit("attack.t1"), F.lpad(k, 3, "0")), F.lit("attack.execution"), F.lit("ATTACK.T1059.001"), F.lit("attack.t1059.001"))
    return _table(s, d, "part").select("p_partkey", F.array_join(S.tags_to_techniques(tags), ",").alias("techniques"))


@_add("fn_sanitize_case")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select("p_partkey", S.sanitize_case(F.concat(F.lit(" /"), "p_type", F.lit(": "), "p_name", F.lit("!"))).alias("case_name"))


@_add("fn_qualified_user")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    domain = F.when(k == 0, "-").when(k == 1, " ").otherwise("CORP")
    return _table(s, d, "customer").select("c_custkey", S.qualified_user(domain, F.col("c_name")).alias("who"))


@_add("fn_service_flags")
def _(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).filter("source = 'services'")
    start = (F.col("id") % 5).cast("string")
    return e.select("id", S.start_type(start).alias("start"), F.array_join(S.service_flags(F.col("file_path"), start), ",").alias("flags"))
