import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evtrail.llm import collocations


def by_hand(rows, least, longest, most):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {}
    for p, a in often.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inside[p[0], *p[i : i + k]] = max(a, inside.get((p[0], *p[i : i + k]), 0))
    out = []
    for p, a in often.items():
        if 100 * inside.get(p, 0) >= 100 * a:
            continue
        score, k = min((1000 * a * n[p[0]] // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[p[0], *p[k + 1 :]]))
    kept = []
    for lang in sorted({x[0] for x in out}):
        for rank, (_, score, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:most], 1):
            kept.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return kept


def corpus():
    r = random.Random(8)
    words = ["of", "the", "The", "état", "x", "a.b", "new", "York", "city", "\x1cw", "中", "hall"]
    rows = [(None, "en"), ("", None), (" \t. ;", "en"), ("..,", "xx"), ("one two", "")]
    for i in range(60):
        text = r.choice(["", "new york city hall ", "of the ", "\n"]).join(" " + r.choice(words) + r.choice(["", " ", "\t", ",", "\x0b", " - "]) for _ in range(r.randint(0, 60)))
        rows.append((text, r.choice(["en", "fr", None, "und"])))
    rows += [rows[-1], rows[-1]]
    return rows


@pytest.mark.parametrize("chunk", [4 << 20, 50])
def test_collocations_as_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, f int, p string, `h.h` int").repartition(3)
    for least, most in ((3, 2000), (6, 5)):
        got = collocations.best(collocations.collocations(docs, least), most).collect()
        want = by_hand(rows, least, 5, most)
        assert len(want) > 10
        assert sorted(map(tuple, got)) == want


def test_no_rows_and_nothing_frequent(spark, empty):
    assert collocations.report(empty).collect() == []
    few = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.report(few).collect() == []


def test_chunks_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 7)
    for text in (b"", b"a", b"abcdefghijklmno", b"a bb ccc dddd eeeeeeeeeee f ", b" " * 30):
        assert b"".join(collocations._chunks(text)) == text


def test_scores_are_exact_past_64_bits(spark):
    rows = [(10**13 - 7, 3 * 10**13 + 11, 10**13 + 1, 10**13 - 3), (2, 7, 3, 5), (9 * 10**12, 10**13, 9 * 10**12, 9 * 10**12)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.cut_score(*[F.col(c) for c in "anlr"]).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == sorted((*x, 1000 * x[0] * x[1] // (x[2] * x[3])) for x in rows)
