import random
from collections import Counter

import pytest

from evtrail.llm import topk


def brute(rows, k=10):
    import math

    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = Counter()
    for q, a in own:
        if q % 100 == 0:
            clamped = lambda s: max(-(2**63), min(2**63 - 1, s))
            every = sorted((-clamped(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in own if i != q and len(a) == len(b))
            for rank, (s, i) in enumerate(every[:k], 1):
                out[(q, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_as_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", block)
    monkeypatch.setattr(topk, "PASS_BYTES", 3 * block)
    monkeypatch.setattr(topk, "SEED", 40)
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "STEP", 16)
    r = random.Random(0)
    rows = [(i, [r.gauss(0, 0.2) * (1 + i % 7) for _ in range(24)]) for i in range(450)]
    rows += [(i, rows[3][1]) for i in range(450, 480)]  # ties
    rows += [rows[200], rows[200], rows[7]]  # repeated rows
    rows += [(500, None), (600, []), (601, [1.0, None]), (602, [float("nan")] * 24), (603, [float("inf")] * 24), (None, rows[0][1]), (700, [1.0, 2.0]), (701, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = topk.integer_vectors(df)
    got = Counter(tuple(x) for x in topk.top_k(v.filter("vec_id % 100 = 0"), v).collect())
    assert got == brute(rows)


def test_empty(spark):
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).collect() == []


def test_scores_past_a_long(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 0, 3, 9, 15, 200, 308]) for _ in range(6)]) for i in range(0, 2000, 20)]
    rows += [(100, [1e15] * 6), (200, [1.7e308] + [0.0] * 5), (300, [-1e15] * 6), (7, [1e15] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = topk.integer_vectors(df)
    assert Counter(tuple(x) for x in topk.top_k(v.filter("vec_id % 100 = 0"), v).collect()) == brute(rows)


def test_short_candidates_are_left_out_by_their_files(spark):
    r = random.Random(2)
    rows = [(i, [abs(r.gauss(0, 1)) * (100 if i < 60 else 0.001) for _ in range(8)]) for i in range(3000)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(4)
    queries = v.filter("vec_id = 0")
    plan = topk.top_k(queries, v)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length" in plan
    assert Counter(tuple(x) for x in topk.top_k(queries, v).collect()) == Counter({k: n for k, n in brute(rows).items() if k[0] == 0})
