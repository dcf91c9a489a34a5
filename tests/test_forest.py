import random

import pytest
from pyspark.sql import functions as F

from evtrail.operators import forest, lineage
from evtrail.tables import scanned, written

from .test_engine import make


def by_hand(parents, order):
    below = {}
    for i, p in parents.items():
        below.setdefault(p, []).append(i)
    out = {}

    def visit(root):
        # Without recursion: the chain may be deep.
        stack, n = [(root, 0, False)], 0
        while stack:
            i, depth, left = stack.pop()
            if left:
                out[i] = (*out[i], n - out[i][2])
                continue
            out[i] = (root, depth, n)
            n += 1
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for c in sorted(below.get(i, []), key=lambda c: (order[c], c), reverse=True)]

    for root in below.get(None, []):
        visit(root)
    return out


@pytest.mark.parametrize("here", [forest.HERE, 40])
def test_forest_as_walked(spark, here):
    """In one task, and by contracted lists."""
    r = random.Random(here)
    parents = {i: (None if i < 4 or r.random() < 0.02 else r.choice([0, i - 1, r.randrange(i)])) for i in range(400)}
    parents |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {1100: 1003, 1101: 1100, 1200: 9999, 1201: 1200}
    order = {i: r.randrange(9) for i in parents}
    nodes = spark.createDataFrame([(i, p, order[i]) for i, p in parents.items()], "id long, parent long, order int")
    got = {x["id"]: (x["root"], x["depth"], x["pre"], x["size"]) for x in forest.forest(nodes, here).collect()}
    assert got == by_hand({i: p for i, p in parents.items() if i < 1000}, order)
    heads = [3, 17, 200, 201]
    under = forest.below(written(forest.forest(nodes, here)), spark.createDataFrame([(h,) for h in heads], "id long"))
    at = {h: got[h] for h in heads}
    assert {x["id"] for x in under.collect()} == {i for i, x in got.items() if any(x[0] == h[0] and h[2] <= x[2] < h[2] + h[3] for h in at.values())}


def test_a_deep_chain_takes_rows_in_proportion(spark, monkeypatch):
    n, rows = 100_000, []
    plain = forest.written
    monkeypatch.setattr(forest, "written", lambda df: rows.append((out := plain(df)).count()) or out)
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("order"))
    told = written(forest.forest(nodes, here=20_000))
    assert told.filter("depth = id AND pre = id AND root = 0").count() == n
    assert told.filter(F.col("size") == n - F.col("id")).count() == n
    assert max(rows) <= 2 * n and sum(rows) < 30 * n


def test_lineage_forest_as_closure(spark):
    r = random.Random(6)
    rows = [{"process_id": r.randint(1, 25), "process_name": r.choice("abcd") + ".exe", "parent_id": r.choice([None, r.randint(1, 25)]), "at": r.randint(0, 40)} for _ in range(150)]
    inst = written(lineage.instances(make(spark, *rows)))
    links = written(lineage.parents(inst))
    up = lineage.ancestors(links).collect()
    deep, many = {}, {}
    for x in up:
        deep[x["first_id"]] = max(deep.get(x["first_id"], 0), x["depth"])
        many.setdefault(x["ancestor"], set()).add(x["first_id"])
    assert {x["first_id"]: x["depth"] for x in lineage.depths(inst, links).collect()} == {x["first_id"]: deep.get(x["first_id"], 0) for x in links.collect()}
    assert {x["ancestor"]: x["descendants"] for x in lineage.descendants(inst, links).collect()} == {a: len(s) for a, s in many.items()}
    heads = inst.filter("img = 'a.exe'").select("first_id")
    own = {x["first_id"] for x in heads.collect()}
    assert {x["first_id"] for x in lineage.focused(inst, links, heads).collect()} == own | {i for a in own for i in many.get(a, ())}
    assert len(lineage.tree_text(inst, links)) == len(lineage.trees(inst, links).collect())


def test_running_values_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b"]), r.randint(0, 50), i, r.choice([None, r.randint(0, 99)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").withColumn("x", F.when(F.col("v").isNotNull(), F.struct("v", "id")))
    wanted = {"top": ("max", "x"), "total": ("sum", "v")}
    for earlier in (False, True):
        one, many = (scanned(df, ["k"], ["t", "id"], wanted, earlier, hot) for hot in (10**6, 100))
        assert sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, many.select(*sorted(one.columns)).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = scanned(df.filter("k = 'a'"), ["k"], ["t", "id"], wanted, hot=100)
        assert spread.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parents_and_references_of_a_hot_pid(spark):
    r = random.Random(5)
    rows = [{"process_id": r.choice([7, 7, 7, r.randint(1, 9)]), "process_name": f"p{r.randint(0, 60)}.exe", "parent_id": r.choice([None, 7, r.randint(1, 9)]), "at": r.randint(0, 60), "event_id": r.choice(["1", "1", "3"])} for _ in range(400)]
    e = written(make(spark, *rows))
    inst = written(lineage.instances(e))
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(lineage.parents(inst)) == flat(lineage.parents(inst, hot=20))
    assert flat(lineage.references(e, inst)) == flat(lineage.references(e, inst, hot=20))
