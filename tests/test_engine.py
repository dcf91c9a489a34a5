import ipaddress
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evtrail.functions import network
from evtrail.functions import scalars as S
from evtrail.operators import attack, correlate, entities, lineage, query, rules, sigma
from evtrail.schema import conform

T0 = datetime(2026, 1, 1, tzinfo=UTC)
COLUMNS = "id long, timestamp timestamp, timestamp_original string, source string, event_id string, host string, user string, process_name string, parent_name string, process_id long, parent_id long, command_line string, src_ip string, dst_ip string, dst_port int, file_path string, registry_key string, raw string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def make(spark, *rows):
    full = []
    for i, r in enumerate(rows, 1):
        at = T0 + timedelta(seconds=r.pop("at", i))
        base = dict.fromkeys(NAMES) | {"id": i, "timestamp": at, "timestamp_original": at.isoformat(), "source": "sysmon", "event_id": "1", "host": "WS-1"}
        full.append(tuple((base | r)[n] for n in NAMES))
    return conform(spark.createDataFrame(full, COLUMNS))


def ids(df, *cols):
    return sorted(tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect())


def fire(spark, rule, *rows):
    r = rules.BY_ID[f"EV-DET-{rule}"]
    return [x.asDict() for x in r.findings(make(spark, *rows)).orderBy("event_id").collect()]


def test_encoded_powershell(spark):
    hit = fire(spark, "ENCPSH", {"process_name": "C:\\x\\PowerShell.exe", "command_line": "powershell -enc QQ=="}, {"process_name": "powershell.exe", "command_line": "powershell -File a.ps1"}, {"process_name": "cmd.exe", "command_line": "x -enc y"})
    assert [h["event_id"] for h in hit] == [1] and hit[0]["severity"] == "high"


def test_office_download_temp_and_ports(spark):
    assert len(fire(spark, "OFFICE", {"process_name": "cmd.exe", "parent_name": "C:\\WINWORD.EXE"}, {"process_name": "cmd.exe", "parent_name": "explorer.exe"})) == 1
    assert fire(spark, "DLPSH", {"source": "powershell", "event_id": "4104", "raw": "(New-Object Net.WebClient)"}, {"process_name": "powershell.exe", "command_line": "dir"})[0]["detail"] == "Net.WebClient"
    assert [h["detail"] for h in fire(spark, "TEMPEXEC", {"command_line": '"C:\\Temp\\a b.exe" /x'}, {"command_line": "C:\\Windows\\a.exe"})] == ["C:\\Temp\\a b.exe"]
    port = {"event_id": "3", "dst_ip": "8.8.8.8"}
    assert [h["event_id"] for h in fire(spark, "RAREPORT", port | {"dst_port": 4444}, port | {"dst_port": 443}, port | {"dst_port": 4444, "dst_ip": "192.168.1.5"}, port | {"dst_port": None}, port | {"dst_port": 99, "dst_ip": "2606:4700::1"})] == [1, 5]


def test_run_key_is_worse_once_executed(spark):
    key = {"source": "registry", "event_id": "run-key", "registry_key": "x\\Run\\a", "file_path": "C:\\t\\evil.exe"}
    assert fire(spark, "RUNKEY", dict(key))[0]["severity"] == "medium"
    hit = fire(spark, "RUNKEY", dict(key), {"process_name": "EVIL.EXE"})
    assert (hit[0]["severity"], hit[0]["confidence"]) == ("high", 85)


def brute_burst(rows):
    out = {}
    for key in {(u, a) for u, a, _, _ in rows}:
        own = sorted((s, i) for u, a, s, i in rows if (u, a) == key)
        best = max(((sum(1 for s, _ in own if e - 600 <= s <= e), -e) for e, _ in own), default=(0, 0))
        if best[0] >= 5:
            out[key] = [i for s, i in own if -best[1] - 600 <= s <= -best[1]]
    return out


def test_burst_as_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice("xy"), r.randint(0, 3000), i) for i in range(1, 60)]
    got = fire(spark, "BRUTE", *[{"source": "evtx:Security", "event_id": "4625", "user": u, "src_ip": a, "at": s, "id": i} for u, a, s, i in rows])
    assert sorted(h["evidence"] for h in got) == sorted(brute_burst(rows).values())


def test_admin_host_needs_history(spark):
    logon = lambda u, a: {"source": "evtx:Security", "event_id": "4624", "user": u, "src_ip": a}
    got = fire(spark, "ADMINHOST", logon("C\\admin-1", "10.0.0.1"), logon("C\\admin-1", "10.0.0.1"), logon("C\\admin-1", "10.0.0.2"), logon("C\\user", "10.0.0.3"), logon("C\\user", "10.0.0.4"), logon("C\\admin-1", "-"), logon("C\\administration", "1"), logon("C\\administration", "2"))
    assert [h["event_id"] for h in got] == [3]


def test_detect_numbers_and_selects(spark):
    e = make(spark, {"process_name": "powershell.exe", "command_line": "powershell -enc QQ=="}, {"source": "services", "event_id": "service", "file_path": "C:\\Temp\\a.exe"})
    assert [r["uid"] for r in rules.numbered(rules.detect(e)).orderBy("uid").collect()] == ["EV-0001", "EV-0002"]
    assert ids(rules.applicable(e), "rule_id") == sorted(["EV-DET-SVC", "EV-DET-ENCPSH", "EV-DET-DLPSH", "EV-DET-OFFICE", "EV-DET-TEMPEXEC"])
    with pytest.raises(ValueError):
        rules.select_rules(["nope"])
    assert attack.mapping_faults(spark).count() == 0


def test_external_addresses_as_the_standard_library(spark):
    r = random.Random(1)
    ips = [".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(300)] + ["8.8.8.8", "01.2.3.4", "1.2.3.04", "172.15.0.1", "172.31.0.1", "172.32.0.1", "198.17.0.1", "198.19.9.9", "198.20.0.1", "223.1.1.1", "255.255.255.255", "10.0.0.1", "203.0.113.9", "192.0.0.9", "192.0.0.8", "100.64.0.1", "256.1.1.1", "x", "", "::1", "2001:db8::1", "2606:4700::1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", network.external(F.col("ip")).alias("x"))
    for row in df.collect():
        try:
            ip = ipaddress.ip_address(row["ip"])
            want = not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)
        except ValueError:
            want = False
        assert row["x"] == want, row["ip"]


def test_scalars(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c.alias("x")).first()["x"]
    c = F.col("c0")
    for text, want in (("2026-01-02T03:04:05.99Z", "03:04:05"), ("2026-01-02T03:04:05+02:00", "01:04:05"), ("2026-01-02 03:04:05", "03:04:05"), ("2026", None), ("T10:00", None), ("junk", None)):
        assert one(F.date_format(S.normalize_timestamp(c), "HH:mm:ss"), text) == want
    assert one(S.parse_pid(c), "0x1f4") == 500 and one(S.parse_pid(c), "0") is None and one(S.parse_pid(c), "x") is None
    assert one(S.parse_port(c), "70000") is None and one(S.parse_port(c), "0") == 0
    assert one(S.parse_hashes(c), "MD5=a, SHA1=b,MD5=c,bad") == {"sha1": "b", "md5": "c"}
    assert one(S.normalize_user(c), "CORP\\Ann\\x") == "ann\\x@corp"
    assert one(S.basename(c), None) == "" and one(S.basename(c), "C:/a\\B.exe") == "b.exe"
    assert one(S.csv_safe(c), "=1") == "'=1" and one(S.csv_safe(c), "a") == "a"
    assert one(S.sanitize_case(c), "..a b/c..") == "a-b-c"
    assert one(S.service_flags(c, F.lit("2")), "C:\\Temp\\a b.exe") == ["auto-start", "image-in-temp-dir", "unquoted-service-path"]


def test_query_and_timeline(spark):
    e = make(spark, {"user": "Ann", "command_line": "abc%x"}, {"host": "ws-1", "timestamp_original": None}, {"host": "B", "at": 100, "process_name": "p.exe", "process_id": 5, "parent_name": "q.exe", "parent_id": 4})
    assert ids(query.events_where(e, host="ws-1"), "id") == [1, 2]
    assert ids(query.events_where(e, keyword="B%X"), "id") == [1]
    assert [r["id"] for r in query.page(e, 1, 1).collect()] == [2]
    assert ids(query.in_scope(e, start="2026-01-01T00:00:00Z"), "id") == [1, 3]
    assert query.timeline(e).filter("id = 3").first()["summary"] == "p.exe(5) started by q.exe(4)"
    with pytest.raises(ValueError):
        query.in_scope(e, "2026-01-02", "2026-01-01")
    with pytest.raises(ValueError):
        query.page(e, 1, -1)


def test_entities_keep_untimed_out_of_first_and_last(spark):
    e = make(spark, {"user": "CORP\\Ann"}, {"user": "corp\\ANN", "at": 50, "timestamp_original": None})
    row = entities.entities(e, "user").first()
    assert (row["value"], row["count"], row["observed_as"]) == ("ann@corp", 2, ["CORP\\Ann", "corp\\ANN"])
    assert row["first_seen"] == row["last_seen"] == "2026-01-01T00:00:01Z"


def test_lineage(spark):
    e = make(
        spark,
        {"process_id": 1, "process_name": "a.exe"},
        {"process_id": 2, "process_name": "b.exe", "parent_id": 1},
        {"process_id": 1, "process_name": "c.exe"},
        {"process_id": 3, "process_name": "d.exe", "parent_id": 1},
        {"event_id": "3", "process_id": 1, "process_name": "c.exe"},
        {"process_id": 4, "process_name": "e.exe", "parent_id": 99},
        {"process_id": 5, "process_name": "f.exe", "parent_id": 3},
    )
    inst = lineage.instances(e)
    links = {r["first_id"]: (r["parent_first_id"], r["candidates"]) for r in lineage.parents(inst).collect()}
    assert links == {1: (None, 0), 2: (1, 1), 3: (None, 0), 4: (3, 2), 6: (None, 0), 7: (4, 1)}
    assert ids(lineage.pid_reuse(inst), "pid") == [1]
    assert ids(lineage.references(e, inst), "first_id", "references") == [(3, 1)]
    assert ids(lineage.ancestors(lineage.parents(inst)), "first_id", "ancestor", "depth") == [(2, 1, 1), (4, 3, 1), (7, 3, 2), (7, 4, 1)]
    assert lineage.tree_text(inst, lineage.parents(inst))[0] == "a.exe (1)"


def test_lineage_of_ties_ends(spark):
    e = make(spark, {"process_id": 1, "process_name": "a.exe", "parent_id": 2, "at": 0}, {"process_id": 2, "process_name": "b.exe", "parent_id": 1, "at": 0})
    assert len(lineage.ancestors(lineage.parents(lineage.instances(e))).collect()) == 2


def test_ancestors_of_any_depth(spark):
    # A chain of 150, another that runs into a ring of 70, and a fork.
    up = {i: i - 1 for i in range(1, 150)} | {0: None, 500: 140} | {200 + i: 200 + (i + 1) % 70 for i in range(70)} | {300: 301, 301: 205}
    want = set()
    for i in up:
        seen, at = [i], up[i]
        while at is not None and at not in seen:
            want.add((i, at, len(seen)))
            seen.append(at)
            at = up[at]
    got = lineage.ancestors(spark.createDataFrame(list(up.items()), "first_id long, parent_first_id long")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and max(r["depth"] for r in got) == 149


def test_sigma(spark):
    e = make(spark, {"process_name": "C:\\x\\cmd.exe", "command_line": "a[b]"}, {"process_name": "power.exe"}, {"process_name": None})
    rule = lambda condition, **sel: sigma.load({"title": "t", "id": "t", "level": "low", "detection": sel | {"condition": condition}})
    hits = lambda *a, **b: ids(sigma.run(e, rule(*a, **b)), "event_id")
    assert hits("s", s={"Image": "*\\CMD.exe"}) == [1]
    assert hits("not s", s={"Image": "*cmd.exe"}) == [2, 3]
    assert hits("1 of s*", s1={"Image": "*cmd*"}, s2={"Image": "p?wer.exe"}) == [1, 2]
    assert hits("all of s* or x and not s1", s1={"Image": "*cmd*"}, s2={"CommandLine": "a*"}, x={"Image": "[!c]ower.exe"}) == [1, 2]
    for bad in ("(s)", "s and", "q", "1 of them", "s s", "2 of z*"):
        with pytest.raises(sigma.SigmaError):
            rule(bad, s={"Image": "x"})
    for fields in ({"Image|contains": "x"}, {"Nope": 1}):
        with pytest.raises(sigma.SigmaError):
            rule("s", s=fields)
    assert len(sigma.samples()) == 4


def test_many_sigma_rules_in_one_scan(spark):
    r = random.Random(12)
    words = ["cmd", "*cmd*", "a?b*", "*[0-9]x*", "*", "", "?", "[!a]*", "*.exe", "c:\\\\*\\run*", "x[", "ÄB*", "4444", "*é*"]
    texts = ["cmd", "CMD.EXE", "a1b2", "9x", "", "C:\\t\\Run.exe", "x[", "äbc", "É", "a-b", None]
    fields = ["Image", "CommandLine", "ParentImage", "DestinationPort", "User", "ComputerName", "TargetObject"]
    made = []
    for i in range(500):
        names = ["sel_a", "sel_b", "other"][: r.randint(1, 3)]
        detection = {n: {f: (r.choice(words) if r.random() < 0.6 else r.sample(words, 2)) for f in r.sample(fields, r.randint(1, 2))} for n in names}
        conditions = ["sel_a", "not sel_a", "1 of sel_*", "all of sel_*", f"sel_a or not {names[-1]}", f"{names[-1]} and not sel_a", "2 of sel_*", "0 of sel_*"]
        made.append(sigma.load({"title": "t", "id": f"r{i}", "level": r.choice(list(sigma.LEVELS)), "logsource": r.choice([{}, {"category": "process_creation"}, {"service": "security"}]), "tags": ["attack.t1001", "attack.T1001.002"], "detection": detection | {"condition": r.choice(conditions)}}))
    rows = []
    for _ in range(60):
        rows.append({"source": r.choice(["sysmon", "evtx:Security"]), "event_id": r.choice(["1", "3"]), "process_name": r.choice(texts), "command_line": r.choice(texts), "parent_name": r.choice(texts), "dst_port": r.choice([None, 4444, 80]), "user": r.choice(texts), "host": r.choice(texts), "registry_key": r.choice(texts)})
    e = make(spark, *rows)
    flat = lambda df: sorted(tuple(x) for x in df.collect())
    many = sigma.run_all(e, made)
    got = flat(many)
    # By a column for each rule, some at a time.
    want = []
    for i in range(0, 500, 50):
        names = {x.id: x for x in made[i : i + 50]}
        hits = e.select("id", F.array_compact(F.array(*[F.when(sigma.predicate(x), F.lit(n)) for n, x in names.items()])).alias("h")).collect()
        want += [(n, names[n].level, sigma.LEVELS[names[n].level], x["id"], "T1001,T1001.002") for x in hits for n in x["h"]]
    assert got == sorted(want) and len(got) > 1000
    assert flat(sigma.run_all(e, made[:5])) == [x for x in got if x[0] in {y.id for y in made[:5]}]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_sigma_yaml():
    text = "title: T # c\nid: t-1\nlevel: high\ntags:\n  - attack.t1059.001\nlogsource:\n  category: process_creation\ndetection:\n  sel:\n    Image: ['*a.exe', \"b\"]\n    DestinationPort: 44\n  condition: sel\n"
    rule = sigma.load(sigma.plain_yaml(text))
    assert rule.selections == {"sel": {"Image": ["*a.exe", "b"], "DestinationPort": 44}} and rule.logsource == {"category": "process_creation"}
    with pytest.raises(sigma.SigmaError):
        sigma.plain_yaml("a: &x 1")


def chain(spark):
    p = {"process_id": 10, "process_name": "w.exe"}
    return make(
        spark,
        p | {"at": 0},
        p | {"event_id": "3", "dst_ip": "8.8.8.8", "dst_port": 4444, "at": 10},
        p | {"event_id": "11", "file_path": "C:\\Temp\\drop.exe", "at": 20},
        {"source": "registry", "event_id": "run-key", "registry_key": "x\\Run\\a", "file_path": "C:/Temp/drop.exe", "at": 30},
        {"process_id": 11, "process_name": "DROP.exe", "parent_id": 10, "at": 40},
        {"process_id": 12, "process_name": "lone.exe", "at": 9000, "host": "WS-9"},
        {"source": "prefetch", "event_id": "prefetch", "process_name": "DROP.EXE", "at": 1000},
    )


def test_links_and_clusters(spark):
    e = chain(spark)
    got = {(r["kind"], r["event_a"], r["event_b"], r["confidence"]) for r in correlate.linkages(e).collect()}
    assert got == {
        ("same-process", 1, 2, 90), ("same-process", 2, 3, 90), ("same-file", 3, 4, 80), ("same-file", 7, 5, 65),
        ("persistence-execution", 4, 5, 60), ("persistence-execution", 4, 7, 60), ("download-execution", 2, 5, 85),
    }
    members = correlate.clusters(e)
    assert ids(members, "id", "root") == [(i, 1) for i in (1, 2, 3, 4, 5, 7)]
    ranked = correlate.ranked(e, rules.detect(e), members).collect()
    assert [(r["cluster_id"], r["root"], r["events"]) for r in ranked] == [(0, 1, 6)]
    assert correlate.confidence(correlate.linkages(e), members).first()["confidence"] == 60
    assert ids(correlate.missing_prefetch(e), "base") == ["lone.exe", "w.exe"]
    assert correlate.missing_network(e).count() == 0


def test_missing_network_as_brute_force(spark):
    r = random.Random(4)
    rows = []
    for _ in range(300):
        at, host = r.randint(0, 60_000), r.choice(["WS-1", "ws-1 ", "WS-2"])
        if r.random() < 0.6:
            rows.append({"event_id": "3", "dst_ip": r.choice(["8.8.8.8", "10.0.0.1"]), "dst_port": 80, "at": at, "host": host})
        else:
            rows.append({"event_id": r.choice(["1", "11", "5"]), "file_path": r.choice(["", "c:\\x.exe"]), "at": at, "host": host})
    rows += [{"event_id": "3", "dst_ip": "8.8.8.8", "at": 90_000, "host": "E"}, {"event_id": "11", "file_path": "x", "at": 90_900, "host": "E"}, {"event_id": "3", "dst_ip": "8.8.8.8", "at": 89_999, "host": "E"}]
    name = lambda x: x["host"].strip().lower()
    follows = [(name(x), x["at"]) for x in rows if x.get("file_path") or x["event_id"] == "1"]
    want = [i for i, x in enumerate(rows, 1) if x.get("dst_ip") == "8.8.8.8" and not any(h == name(x) and 0 <= t - x["at"] <= 900 for h, t in follows)]
    got = correlate.missing_network(make(spark, *rows))
    assert sorted(y["id"] for y in got.collect()) == want
    assert len(rows) in want and len(rows) - 2 not in want


def test_persistence_pairs_stand_once(spark):
    run = {"source": "registry", "event_id": "run-key", "registry_key": "x\\Run\\a", "file_path": "C:/Temp/a.exe"}
    e = make(spark, run, {"process_name": "a.exe"}, {"process_name": "a.exe", "file_path": "c:\\temp\\A.exe"}, {"process_name": "other.exe", "file_path": "c:\\temp\\a.exe"}, {"process_name": "a.exe", "host": "X"})
    got = correlate.persistence_execution(correlate.prepared(e))
    assert ids(got, "event_a", "event_b", "confidence") == [(1, 2, 60), (1, 3, 80), (1, 4, 80)]


def test_link_classes_as_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for _ in range(260):
        kind = r.choice(["start", "start", "file", "net", "key", "task", "prefetch"])
        name, host = r.choice(["a.exe", "b.exe", "C.exe"]), r.choice(["WS-1", "WS-2"])
        path = r.choice(["", f"c:\\t\\{name}", f"C:/u/{name}", "c:\\t\\a.exe"])
        base = {"host": host, "process_name": name, "at": r.randint(0, 20_000), "process_id": r.randint(1, 3), "file_path": path}
        rows.append(base | {
            "start": {"parent_id": r.randint(1, 3)}, "file": {"event_id": "11"}, "net": {"event_id": "3", "dst_ip": "8.8.8.8"}, "key": {"source": "registry", "event_id": "run-key"},
            "task": {"source": "tasks", "event_id": "task"}, "prefetch": {"source": "prefetch", "event_id": "prefetch"},
        }[kind])
    e = make(spark, *rows)
    pairs = [tuple(x) for x in correlate.linkages(e).collect()]
    classes = correlate.link_classes(correlate.prepared(e))
    assert {(x["kind"], x["n"]) for x in correlate.stats(classes).collect()} == set(Counter(x[0] for x in pairs).items())
    members = correlate.clusters(e)
    weakest = lambda links: sorted(map(tuple, correlate.confidence(links, members).collect()))
    assert weakest(classes) == weakest(correlate.linkages(e))
    by = Counter()
    for x in classes.collect():
        by[x["kind"], x["confidence"]] += x["links"]
    assert by == Counter((x[0], x[3]) for x in pairs)
    root = members.groupBy("root").count().orderBy("count").first()["root"]
    own = {x["id"] for x in members.collect() if x["root"] == root}
    assert sorted(map(tuple, correlate.cluster_links(e, members, root).collect())) == sorted(x for x in pairs if x[1] in own)


def test_classes_grow_with_events_not_with_pairs(spark):
    path = {"process_name": "a.exe", "file_path": "c:\\a.exe", "process_id": 1}
    e = make(spark, *[path | {"at": 1000 * i} for i in range(300)], *[{"source": "tasks", "event_id": "task", "file_path": "c:\\a.exe", "at": i} for i in range(300)])
    rows = {(x["kind"], x["by"]): (x["left"], x["right"], x["links"]) for x in correlate.link_classes(correlate.prepared(e)).collect() if x["by"] in ("path", "name")}
    assert rows == {("same-file", "path"): (600, 600, 600 * 599 // 2), ("persistence-execution", "path"): (300, 300, 90_000)}


def test_components_as_union_find(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = correlate.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_download_patterns_as_written(spark):
    hit = ["Invoke-WebRequest x", "iwr x", "irm x", "New-Object Net.WebClient", "x.DownloadString(1)", "DownloadFile", "bitsadmin /transfer j", "Start-BitsTransfer", "certutil -urlcache -f", "curl http://a -o b", "curl.exe -k x -O", "wget x", "wget.exe x"]
    miss = ["my_bitsadmin_x transferred", "curl https://h/a-o.txt", "libcurl foo-o", "xiwr", "certutil -decode", "wgetx y", "plain text"]
    rows = [dict(id=i, source="powershell", event_id="4104", command_line=t) for i, t in enumerate(hit + miss, 1)]
    assert [r["event_id"] for r in fire(spark, "DLPSH", *rows)] == list(range(1, len(hit) + 1))


def test_one_scan_finds_what_each_rule_finds(spark):
    e = make(spark, dict(id=1, source="sysmon", event_id="1", process_name="C:\\w\\powershell.exe", parent_name="winword.exe", command_line="C:\\temp\\powershell.exe -enc QQ== iwr x"), dict(id=2, source="services", event_id="service", file_path="C:\\Temp\\x.exe"))
    every = {(r["rule_id"], r["event_id"]) for r in rules.detect(e).collect()}
    assert every == {(r["rule_id"], r["event_id"]) for rule in rules.RULES for r in rule.findings(e).collect()}
    assert every == {("EV-DET-ENCPSH", 1), ("EV-DET-DLPSH", 1), ("EV-DET-OFFICE", 1), ("EV-DET-TEMPEXEC", 1), ("EV-DET-SVC", 2)}
    # One scan for the seven rules on single events, one for the first logons, two each for bursts and Run keys.
    assert rules.detect(e)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 6


def test_findings_are_explained(spark):
    e = make(spark, dict(id=1, source="sysmon", event_id="1", host="WS", process_name="powershell.exe", command_line="powershell -enc QQ=="))
    r = rules.explained(rules.detect(e), e).collect()[0]
    assert (r["title"], r["mitre"], r["provenance"]) == ("PowerShell with an encoded command", ["T1059.001"], "rules")
    assert r["what"] == "PowerShell on WS ran an encoded command: powershell -enc QQ=="
    assert all(r[c] for c in ("why", "observed", "inferred", "confidence_reason"))
    assert set(rules.TEXTS) == {x.id for x in rules.RULES}


def test_findings_cite_their_events(spark):
    fail = {"source": "evtx:Security", "event_id": "4625", "user": "eve", "src_ip": "1.2.3.4"}
    e = make(spark, *[fail | {"at": 10 * (6 - i)} for i in range(6)], {"process_name": "cmd.exe", "parent_name": "winword.exe", "command_line": "cmd /c x"})
    told = {r["rule_id"]: r for r in rules.explained(rules.detect(e), e).collect()}
    burst, office = told["EV-DET-BRUTE"], told["EV-DET-OFFICE"]
    assert [x["event_id"] for x in burst["evidence_refs"]] == burst["evidence"] == [6, 5, 4, 3, 2, 1]
    assert {(x["source"], x["source_event_id"]) for x in burst["evidence_refs"]} == {("evtx:Security", "4625")}
    assert [x["observation"] for x in office["evidence_refs"]] == ["sysmon:1 cmd.exe: cmd /c x"]
    assert all(r["rule_version"] == "1" and r["limitations"] == [rules.LIMITS[i]] for i, r in told.items())
    assert set(rules.LIMITS) == set(rules.TEXTS)


def test_numbers_follow_the_order(spark):
    from evtrail.tables import numbered

    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("v"), (F.col("id") % 3).alias("g"))
    rows = numbered(df, "n", [F.desc("g"), F.asc("v")], 10).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (-r["g"], r["v"]))] == list(range(10, 510))
    assert numbered(df.limit(0), "n", [F.col("v")]).collect() == []


def test_parents_as_all_pairs(spark):
    r = random.Random(6)
    rows = [{"id": i, "host": "h", "process_id": r.randint(1, 6), "parent_id": r.choice([None, 1, 2, 3, 4, 5, 6]), "process_name": f"p{i}.exe", "timestamp": T0 + timedelta(seconds=r.randint(0, 20))} for i in range(1, 80)]
    inst = lineage.instances(make(spark, *rows))
    want = {}
    for c in rows:
        near = sorted((p["timestamp"], p["id"]) for p in rows if p["process_id"] == c["parent_id"] and p["timestamp"] <= c["timestamp"] and p["id"] != c["id"])
        want[c["id"]] = (near[-1][1] if near else None, len(near), [i for _, i in near] if len(near) > 1 else None)
    assert {x["first_id"]: (x["parent_first_id"], x["candidates"], x["ambiguous"]) for x in lineage.parents(inst, ambiguous=True).collect()} == want


def test_technique_files(spark, tmp_path):
    good = tmp_path / "t.json"
    good.write_text('{"techniques": [{"id": "t1059.001", "name": "PowerShell", "tactics": ["Execution"]}]}')
    assert [tuple(r) for r in attack.techniques(spark, str(good)).collect()] == [("T1059.001", "PowerShell", "Execution", True)]
    for body in ("[]", "{}", '{"techniques": []}', '{"techniques": [{"id": "X1", "name": "a", "tactics": ["b"]}]}', '{"techniques": [{"id": "T1000", "name": "a", "tactics": []}]}', '{"techniques": [{"id": "T1000", "name": "a", "tactics": ["b"]}, {"id": "T1000", "name": "c", "tactics": ["b"]}]}'):
        good.write_text(body)
        with pytest.raises(ValueError, match="t.json"):
            attack.load_techniques(str(good))


def test_rules_of_other_packages(spark, monkeypatch):
    own = rules.Rule("X-1", "Own", "low", 10, (), (("sysmon", "1"),), test=lambda: F.when(F.col("event_id") == "1", F.col("host")))
    point = type("Point", (), {"name": "x", "load": lambda self: own})()
    bad = type("Point", (), {"name": "y", "load": lambda self: 1 / 0})()
    monkeypatch.setattr(rules, "_added", {})
    monkeypatch.setattr(rules.metadata, "entry_points", lambda group: [point, bad])
    assert rules.discover() == ["X-1"] and rules.discover() == []
    assert [r["event_id"] for r in rules.detect(make(spark, dict(id=4, source="sysmon", event_id="1", host="h")), ["X-1"]).collect()] == [4]


def test_downloads_are_counted_without_pairs(spark):
    """A row for each session and confidence, not for each pair; a connection that makes the file itself counts too."""
    p = {"process_id": 1, "process_name": "a.exe"}
    rows = [p | {"event_id": "3", "dst_ip": "8.8.8.8", "at": 100 + i} for i in range(20)] + [p | {"event_id": "11", "file_path": "c:\\b.exe", "at": 110 + 100 * i} for i in range(5)]
    rows += [{"process_id": 50 + i, "parent_id": i % 2, "process_name": "b.exe", "at": 105 + 70 * i} for i in range(25)]
    rows += [p | {"process_id": 2, "event_id": "11", "dst_ip": "9.9.9.9", "file_path": "c:\\b.exe", "at": 900}]
    e = make(spark, *rows)
    pairs = correlate.linkages(e).filter("kind = 'download-execution'").collect()
    rows = [x for x in correlate.link_classes(correlate.prepared(e)).collect() if x["by"] == "download"]
    assert len(pairs) > 200 and len(rows) == 3
    for c in (70, 85):
        assert sum(x["links"] for x in rows if x["confidence"] == c) == sum(x["confidence"] == c for x in pairs)
        assert min((x["event_a"], x["event_b"]) for x in rows if x["confidence"] == c) == min((x["event_a"], x["event_b"]) for x in pairs if x["confidence"] == c)
