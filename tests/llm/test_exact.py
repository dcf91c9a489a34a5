import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evtrail.llm import exact


def by_hand(rows):
    groups, out = defaultdict(list), []
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((d, t or ""))
    for s, own in groups.items():
        best = min((-len(t), -(2**63) if d is None else d) for d, t in own)[1]
        keep = None if best == -(2**63) else best
        sha = hashlib.sha256(s.encode()).hexdigest()
        out += [(d, keep, len(own), sha) for d, _ in own]
    return out


def told(frame):
    rows = frame.collect()
    assert all(r["keep_id"] == r["doc_id"] for r in rows if r["kept"])
    for key in {(r["keep_id"], r["text_sha256"]) for r in rows}:
        assert sum(r["kept"] for r in rows if (r["keep_id"], r["text_sha256"]) == key) == 1
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)


def rows_of(plain):
    longer = [t for _, t in plain if t and len(t) > 20]
    extra = [(900 + i, t.replace(" ", "  ")) for i, t in enumerate(longer[:6])]
    extra += [(800, " \t\r\n"), (801, "\x0b\x0c"), (None, longer[0] + " "), (7, "é"), (5, "é"), (5, "é"), (6, "é"), (3, " "), (4, "x" * 300_000), (2, "x" * 299_999 + " x")]
    return [*plain, *extra]


def test_exact_as_brute_force(spark, plain, empty):
    rows = rows_of(plain)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(exact.report(docs)) == sorted(by_hand(rows), key=str)
    assert exact.report(empty).collect() == []


def test_texts_of_one_hash_are_told_apart_by_their_bytes(spark, plain):
    rows = rows_of(plain)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for digest in (lambda s: F.lit(b"same"), lambda s: F.substring(F.md5(s.cast("binary")), 1, 1).cast("binary")):
        assert told(exact.report(docs, digest)) == sorted(by_hand(rows), key=str)


def test_a_group_that_holds_most_rows(spark):
    rows = [(i, "one text" + " " * (i % 3)) for i in range(6000)] + [(9000 + i, f"own {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert told(exact.report(docs).filter("doc_id >= 9000")) == sorted(by_hand(rows[6000:]), key=str)
    large = exact.report(docs).filter("doc_id < 6000").groupBy("keep_id", "group_size").agg(F.count("*"), F.sum(F.col("kept").cast("int"))).collect()
    assert [tuple(r) for r in large] == [(2, 6000, 6000, 1)]


def test_deduplicated_keeps_all_columns(spark):
    rows = [(1, "a b", "x", 1, "r1"), (1, "a b", "w", 2, "r2"), (2, "ab", "y", 3, "r3"), (None, None, None, None, None), (None, "", "q", 4, "r"), (3, " ", "z", 5, "s"), (4, "c", "m", 6, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k string, bits int, `h.v` string")
    out = exact.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "a b", "w", 2, "r2"), (3, " ", "z", 5, "s"), (4, "c", "m", 6, "t")], key=str)
    assert exact.deduplicated(docs.limit(0)).collect() == []
