import random
from collections import Counter

import numpy as np
import xxhash

from evtrail.llm import simhash

NULL = -(2**63)


def brute(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    own = [(NULL if d is None else d, fp(t)) for d, t in rows]
    least = {f: min(d for d, g in own if g == f) for _, f in own}
    changed = True
    while changed:
        changed = False
        for a in least:
            for b in least:
                if (a ^ b).bit_count() <= 2 and least[a] < least[b]:
                    least[b], changed = least[a], True
    return Counter((None if d == NULL else d, format(f, "016x"), None if least[f] == NULL else least[f]) for d, f in own)


def test_as_brute_force(docs, plain, empty):
    assert Counter(tuple(r) for r in simhash.report(docs).collect()) == brute(plain)
    assert simhash.report(empty).collect() == []


def test_links_connect_what_all_pairs_connect(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(f)
            f ^= 1 << r.randrange(64)
    fps |= {0, (1 << 64) - 1}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    root = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and root[a] < root[b]:
                    root[b], changed = root[a], True
    assert {f: got.get(f, f) for f in signed} == root


def groups(rows):
    """The least id of each group of linked fingerprints."""
    own, seen, out = [(NULL if d is None else d, int(f, 16)) for d, f, _ in brute(rows)], set(), []
    for _, f in own:
        if f in seen:
            continue
        group, grown = {f}, True
        while grown:
            more = {g for _, g in own if any((g ^ x).bit_count() <= 2 for x in group)}
            grown, group = not more <= group, group | more
        seen |= group
        out.append(min(d for d, g in own if g in group))
    return Counter(None if d == NULL else d for d in out)


def test_one_of_each(docs, plain, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # Groups that have no id keep a row each, so ids may repeat here.
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == groups(plain)
    assert simhash.one_of_each(empty).collect() == []


def test_one_of_each_with_columns_that_have_no_order(spark):
    rows = [(1, "some words here", {"b": 1}), (1, "some words here", {"a": 2}), (2, "some words here", {"c": 1}), (3, "quite another text of words", None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>"))
    assert sorted((r["doc_id"], r["tags"]) for r in kept.collect()) == [(1, {"a": 2}), (3, None)]


def test_full_tiles_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2)
    monkeypatch.setattr(simhash, "TOGETHER", 2)
    fps = [1 << i for i in range(16)] + [3 << i for i in range(0, 48, 3)] + [(1 << i) | (1 << 40) for i in range(16)]
    got = {r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"))).collect()}
    assert got == {1}


def test_one_of_each_group_that_shares_an_id(spark):
    body = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs", "sphinx of black quartz judge my vow"]
    rows = [(None, body[0], "a"), (None, body[1], "b"), (8, body[1], "c"), (5, body[2], "d"), (5, "how vexingly quick daft zebras jump", "e"), (9, body[2], "f"), (None, body[0], "A"), (4, "", "h"), (4, None, "g")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, body[0], "A"), rows[1], rows[3], rows[4], rows[8]])
