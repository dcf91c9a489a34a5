import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evtrail.llm import passages, suffixes, windows

NULL = -(2**63)


def brute_bytes(rows, depth):
    own = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + depth] for _, b in own for i in range(len(b) - depth + 1))
    out = []
    for d, b in own:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("depth", [400, 60, 24])
def test_suffixes_as_brute_force(docs, plain, depth):
    got = Counter(tuple(r) for r in suffixes.report(docs, depth).collect())
    assert got == brute_bytes(plain, depth)


def test_suffixes_text_and_empty(docs, empty):
    assert suffixes.report(empty).collect() == []
    assert suffixes.without_repeats(docs).count() == docs.count()


def brute_words(rows):
    first = {}
    own = [(NULL if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in own:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        out.append((None if d == NULL else d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_passages_as_brute_force(docs, plain, empty):
    assert Counter(tuple(r) for r in passages.report(docs).collect()) == brute_words(plain)
    assert passages.report(empty).collect() == []
    assert passages.without_passages(docs).count() == docs.count()


def test_sketch_never_underestimates(docs):
    from evtrail.llm.common import keyed

    own = keyed(docs)
    rows = windows.pass_rows(own, windows.word_tokens, passages.DEPTH, passages.WIDTHS[0]).collect()
    n = passages.LEAST_CELLS
    flags = np.frombuffer(b"".join(passages.sketch(own, n)), np.uint8)
    count = Counter(r["f"] for r in rows)
    for f in (f for f, c in count.items() if c > 1):
        for row in range(passages.ROWS):
            at = int(passages.cells(np.array([f], np.int64).view(np.uint64), row, n)[0]) + row * n
            assert flags[at >> 3] >> (at & 7) & 1


def test_repeated_rows_meet_one_list(spark):
    """Rows alike in id and text, with no id above all, cost as many runs each as different rows do."""
    from evtrail.llm.common import keyed

    text = " ".join(f"w{i}" for i in range(150))
    same = spark.createDataFrame([(None, text)] * 300 + [(5, text)] * 20 + [(i, f"{i} {text}") for i in range(10, 14)], "doc_id long, text string").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in same.collect()]
    assert Counter(tuple(r) for r in suffixes.report(same, 60).collect()) == brute_bytes(rows, 60)
    assert Counter(tuple(r) for r in passages.report(same).collect()) == brute_words(rows)
    own = keyed(same)
    runs = windows.pass_rows(own, windows.word_tokens, passages.DEPTH, passages.WIDTHS[0])
    lists = windows.parts(runs).collect()
    alone = windows.pass_rows(keyed(same.filter("doc_id is null").limit(1)), windows.word_tokens, passages.DEPTH, passages.WIDTHS[0]).count()
    assert [len(r["iv"]) for r in lists if r["_k"] == NULL] == [2 * alone]


def repetitive(seed):
    """Texts of one letter, of short periods, and of both beside ordinary words."""
    r = random.Random(seed)
    plain = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n))
    out = ["a" * 3000, "a" * 90, "ab" * 900 + "c" + "ab" * 700, "-" * 70 + "\n" + "=" * 70, ("-" * 40 + "\n") * 60, "x " * 1500, "one two three " * 300, "é" * 800]
    out += [plain(100) + " " + "zz " * 400 + plain(100), "a" * 500 + plain(60) + "a" * 700, "x " * 60, "y x " * 50 + "x " * 80]
    return [(None if i == 3 else i, t) for i, t in enumerate(out + out[4:7])]


def test_periodic_texts_as_brute_force(spark):
    """Some have more than SERIES equal neighbours, others fewer."""
    from evtrail.llm.common import keyed

    rows = repetitive(1)
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (400, 60):
        assert Counter(tuple(r) for r in suffixes.report(some, depth).collect()) == brute_bytes(rows, depth)
    assert Counter(tuple(r) for r in passages.report(some).collect()) == brute_words(rows)
    whole = spark.createDataFrame([(1, "a" * 20_000)], "doc_id long, text string")
    assert windows.pass_rows(keyed(whole), windows.byte_tokens, 400, 250).count() < 5


def test_runs_compared_by_tokens():
    """What is told from tokens alone is what the runs' tokens say."""
    for seed in range(20):
        r = random.Random(seed)
        whole = b"".join(r.choice([b"ab", b"a", b"abc", b"-"]) * r.randint(1, 60) for _ in range(12))
        t = windows.Tokens(whole, None, None, np.array([0, len(whole)]), (np.frombuffer(whole, np.uint8).astype(np.uint64) * windows.MIX) >> np.uint64(32))
        anchor, first, last = windows.runs(t, 24, r.choice([1, 5, 12]))
        if not len(first):
            continue
        windows_series, windows.SERIES = windows.SERIES, 1
        try:
            same = windows.repeats_before(t, 24, first, last)
        finally:
            windows.SERIES = windows_series
        text = [whole[a : b + 24] for a, b in zip(first, last, strict=True)]
        for i in range(1, len(first)):
            assert same[i] == (text[i] == text[i - 1] and first[i] == last[i - 1] + 1 and last[i] - first[i] < windows.PERIOD)
        assert not same[0]
