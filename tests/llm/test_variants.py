import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evtrail.llm import variants


def by_hand(rows, shortest=7, least=2, times=10):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
        out.append((w, len(others)))
    rows = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], k, n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def texts(seed, n=60):
    r = random.Random(seed)
    stems = ["baaaaab", "abababab", "ÉcoleÀÿ×÷", "Variants", "aaaaaaaa", "mississippi", "x" * 90, "".join(r.choice("acgt") for _ in range(80))]
    rows = [(None, None), (1, ""), (2, "short words only"), (3, "1234567 _______ ..."), (None, "Variants variants")]
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(stems)
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÀs") + w[k:], w[:k] + r.choice("abÿx") + w[k + 1 :], w[:k] + w[k:][::-1]])
            words += [w] * r.choice([1, 1, 2, 12])
        rows.append((i, r.choice([" ", "-", "1", "\n", "ƒ"]).join(words)))
    return [*rows, rows[-1]]


@pytest.mark.parametrize(("long", "bits", "part"), [(64, 64, 1 << 16), (8, 64, 300), (10, 6, 1 << 16), (300, 38, 100)])
def test_variants_as_brute_force(spark, monkeypatch, long, bits, part):
    """Long words by their own way, keys that collide, and many parts."""
    monkeypatch.setattr(variants, "LONG", long)
    monkeypatch.setattr(variants, "PART", part)
    plain = variants.near
    monkeypatch.setattr(variants, "near", lambda words: plain(words, ((1 << bits) - 1) << (64 - bits)))
    rows = texts(bits)
    docs = spark.createDataFrame([(d, t, 1, "w", 2) for d, t in rows], "doc_id long, text string, n int, word string, `b.n` int").repartition(3)
    want = by_hand(rows)
    assert sum(f is not None for _, f, *_ in want) > 5
    assert sorted(map(tuple, variants.report(docs).collect()), key=str) == want


def test_chains_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdeeh": 200, "abcddeh": 2000, "zzzzzzz": 2, "zzzzzzy": 19}
    docs = spark.createDataFrame([(None, " ".join([w] * c)) for w, c in counts.items()], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in variants.report(docs).collect()}
    assert got["abcdefg"] == ("abcdefh", "abcddeh")
    assert got["abcddeh"] == (None, "abcddeh")
    assert got["zzzzzzz"] == (None, "zzzzzzz")


def test_no_words(spark, empty):
    assert variants.report(empty).collect() == []
    assert variants.report(spark.createDataFrame([(1, None), (2, "few here")], "doc_id long, text string")).collect() == []


def test_a_word_of_many_letters(spark):
    r = random.Random(3)
    word = "".join(r.choice("abcdefgh") for _ in range(30_000))
    other = word[:20_000] + ("a" if word[20_000] != "a" else "b") + word[20_001:]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([word] * 30 + [other] * 2 + ["q" * 50_000] * 2)], "doc_id long, text string")
    got = {r["word"]: r for r in variants.report(docs).collect()}
    assert got[other]["form"] == word and got[word]["n_near"] >= 1


def test_deletion_keys_are_of_the_strings():
    words = [b"aab", b"aa", b"ab", b"b", b"abcabc"]
    word, place, key = variants.deletion_keys(words)
    by_string = {}
    for w, p, k in zip(word.tolist(), place.tolist(), key.tolist(), strict=True):
        s = words[w] if p < 0 else words[w][:p] + words[w][p + 1 :]
        assert by_string.setdefault(s, k) == k
    assert len(set(by_string.values())) == len(by_string)
    assert Counter(word.tolist()) == Counter({0: 3, 1: 2, 2: 3, 3: 2, 4: 7})
    assert variants.deletion_keys([])[2].dtype == np.uint64
