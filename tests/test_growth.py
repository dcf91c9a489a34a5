import random

import pytest
from pyspark.sql import functions as F

from evtrail.operators import correlate, growth, query
from evtrail.session import CaseSession
from evtrail.tables import written

from .test_engine import make


def random_events(spark, n, seed):
    """Events of few hosts, names and paths, in no order of time, some of them untimed."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        row = {"at": r.randrange(0, 40_000), "host": r.choice(["A", "B", "C", None])}
        name = r.choice(["a.exe", "b.exe", "c.exe", "d.exe", "e.exe"])
        path = r.choice(["C:\\t\\", "C:\\u\\", "D:\\"]) + r.choice([name, f"{r.randrange(30)}.dat"])
        kind = r.randrange(6)
        row |= [
            {"process_id": r.randrange(20), "process_name": name, "parent_id": r.randrange(20)},
            {"event_id": "3", "process_id": r.randrange(20), "process_name": name, "dst_ip": "8.8.8.8", "dst_port": 443},
            {"event_id": "11", "process_id": r.randrange(20), "process_name": name, "file_path": path},
            {"source": "registry", "event_id": "run-key", "registry_key": "x\\Run\\a", "file_path": path},
            {"source": "prefetch", "event_id": "prefetch", "process_name": name},
            {"source": "tasks", "event_id": "task", "file_path": path},
        ][kind]
        rows.append(row)
    out = make(spark, *rows)
    return written(out.withColumn("timestamp_original", F.when(F.col("id") % 17 != 0, F.col("timestamp_original"))))


@pytest.mark.parametrize("seed", [1])
def test_clusters_after_each_append_as_a_full_run(spark, seed):
    every = random_events(spark, 70, seed)
    labels, hubs = spark.createDataFrame([], growth.LABELS), spark.createDataFrame([], growth.HUBS)
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5))
    sizes = set()
    for i in range(5):
        labels, hubs = growth.grow(every.filter(part < i), labels, hubs, every.filter(part == i))
        full = correlate.clusters(every.filter(part <= i))
        got = sorted(map(tuple, labels.select("id", "root").collect()))
        assert got == sorted(map(tuple, full.select("id", "root").collect()))
        sizes.add(len({root for _, root in got}))
    assert len(sizes) > 1
    assert growth.grow(every, labels, hubs, every.limit(0))[0].exceptAll(labels).count() == 0


def test_an_old_group_is_joined_once_it_has_another_side(spark):
    kept = {"source": "registry", "event_id": "run-key", "registry_key": "x\\Run\\a"}
    e = written(make(spark, kept | {"file_path": "C:\\t\\x.exe"}, kept | {"file_path": "D:\\x.exe"}, {"process_name": "x.exe", "at": 90_000}))
    labels, hubs = spark.createDataFrame([], growth.LABELS), spark.createDataFrame([], growth.HUBS)
    labels, hubs = growth.grow(e.limit(0), labels, hubs, e.filter("id < 3"))
    assert labels.count() == 0
    labels, _ = growth.grow(e.filter("id < 3"), labels, hubs, e.filter("id = 3"))
    assert sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1), (3, 1)]


def test_a_case_grows(spark, tmp_path, monkeypatch):
    import evtrail.session

    monkeypatch.setattr(evtrail.session, "MOST_PARTS", 2)
    s = CaseSession(spark, str(tmp_path / "store"), "c").create()
    CaseSession(spark, str(tmp_path / "store"), "other").create()._append(random_events(spark, 5, 9))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for seed in range(4):
        s._append(random_events(spark, 12, seed))
        if seed == 1:
            # Rows of a part that was cut off before it was noted don't count.
            s.store.append("coverage_parts", s.coverage().limit(0).selectExpr("'c' AS case_id", "'cut' AS part", "source", "events", "timestamp(first) AS first", "timestamp(last) AS last"), "part")
        if seed != 2:
            assert s.summarize() == 12 * (seed + 1)
        assert same(s.quick_coverage(), s.coverage())
        assert same(s.quick_entities(), s.entities())
    assert same(s.grown_clusters().select("id", "root"), correlate.clusters(s.all_events()).select("id", "root"))
    s._append(random_events(spark, 12, 7))
    # A batch of a stream that is noted but not there yet: nothing behind it is settled.
    s.store.add("batches", [("c", "x", 0, 61, 3)])
    assert s.store.settled("c") == 60
    s._append(random_events(spark, 4, 8))
    assert s.store.settled("c") == 60 and s.summarize() == 60
    assert same(s.quick_coverage(), s.coverage())
    assert same(s.grown_clusters().select("id", "root"), correlate.clusters(s.all_events()).select("id", "root"))


def test_pages_by_their_last_event(spark):
    every = random_events(spark, 40, 3)
    every = written(every.withColumn("timestamp", F.when(F.col("id") % 9 != 0, F.date_trunc("hour", "timestamp"))))
    want = [(r["t"], r["id"]) for r in query.order(every).select(F.col("timestamp").cast("string").alias("t"), "id", "timestamp").collect()]
    got, after = [], None
    while True:
        page = [(r["t"], r["id"]) for r in query.page_after(every, after, 7).select(F.col("timestamp").cast("string").alias("t"), "id", "timestamp").collect()]
        if not page:
            break
        got += page
        after = page[-1]
    assert got == want


def test_dense_links_are_connected_by_few_edges(spark):
    """Every connection is linked to every start here, and every prefetch entry too: 3,600 and 2,400 links."""
    p = {"process_id": 1, "process_name": "a.exe"}
    rows = [p | {"event_id": "3", "dst_ip": "8.8.8.8", "at": i} for i in range(60)]
    rows += [p | {"event_id": "11", "file_path": f"C:\\t\\{i % 3}\\b.exe", "at": 60 + i} for i in range(30)]
    rows += [{"process_id": 100 + i, "process_name": "b.exe", "at": 100 + i} for i in range(60)]
    rows += [{"source": "prefetch", "event_id": "prefetch", "process_name": "B.EXE", "at": 2000 + i} for i in range(40)]
    rows += [{"process_id": 900, "process_name": "b.exe", "at": 90 + 900 + i} for i in range(3)]
    e = written(make(spark, *rows))
    p = correlate.prepared(e)
    assert correlate.download_execution(p).count() == 3600 and correlate.prefetch(p).count() >= 2400
    assert correlate.star_edges(e).count() <= 3 * len(rows)
    full = correlate.components(correlate.linkages(e).select(F.col("event_a").alias("a"), F.col("event_b").alias("b")))
    assert sorted(map(tuple, correlate.clusters(e).collect())) == sorted(map(tuple, full.collect()))


@pytest.mark.parametrize("seed", [2, 3])
def test_clusters_as_all_links_connect(spark, seed):
    e = random_events(spark, 250, seed)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for x in correlate.linkages(e).collect():
        a, b = sorted((find(x["event_a"]), find(x["event_b"])))
        root[b] = a
    assert {x["id"]: x["root"] for x in correlate.clusters(e).collect()} == {x: find(x) for x in list(root)}
