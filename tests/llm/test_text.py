import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from evtrail.llm import bpe, decontaminate, pieces, private, toxicity

BPE, PIECES = bpe.vocabulary_path(), pieces.vocabulary_path()
needs_bpe = pytest.mark.skipif(not os.path.exists(BPE), reason="no vocabulary")
needs_pieces = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary")


@needs_bpe
def test_bpe_as_the_library(docs, plain, empty):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BPE), bpe.automaton(BPE)
    r = random.Random(1)
    odd = ["".join(r.choice("abcdehint '1.é中\n\t <|>_") for _ in range(r.randint(0, 80))) for _ in range(400)] + ["x<|endoftext|>y", "<|endoftext|>", "a" * 500, " " * 99 + "b"]
    for t in odd:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    want = Counter()
    for d, t in plain:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(docs, BPE).collect()) == want
    assert bpe.token_digests(empty, BPE).collect() == []
    back = bpe.decode(bpe.encode(docs, BPE), BPE)
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, t or "") for d, t in plain)


@needs_bpe
def test_interval_test_of_arcs_as_the_gadgets(spark):
    own, r = bpe.automaton(BPE), random.Random(2)
    tokens = list(own.leads)
    for _ in range(2000):
        s, t = own.leads[r.choice(tokens)], r.choice(tokens)
        assert own._transition(s, t) == own.arc(s, t)


@needs_pieces
def test_forward_and_best_scores_as_brute_force():
    vocab = pieces.vocabulary(PIECES)[:4000]
    number = {p: i for i, p in enumerate(vocab)}
    r = random.Random(4)
    words = sorted({pieces.MARK + "".join(r.choice("abcdeinrstéß中") for _ in range(r.randint(1, 12))) for _ in range(200)})
    rows = [(" ".join(w[1:] for w in words[:100]), "a"), (" ".join(w[1:] for w in words[100:]), "b")]
    model = pieces.Languages.fit(rows, vocab)
    trie = pieces.Trie(words)
    values = model._values(trie)
    longest = model.pieces.longest
    for i, w in enumerate(trie.words.tolist()):
        a = [np.zeros(2)]
        for n in range(1, len(w) + 1):
            a.append(np.logaddexp.reduce([a[n - 1] + model.unknown, *(a[j] + model.logs[number[w[j:n]]] for j in range(max(0, n - longest), n) if w[j:n] in number)], axis=0))
        assert np.allclose(values[i], a[-1])
    counts = pieces.Counts(vocab)
    got = counts.tokens(words)
    for w in words:
        best = [(0.0, 0)]
        for n in range(1, len(w) + 1):
            size = len(w[n - 1].encode())
            options = [(best[n - 1][0] + size * counts.byte_cost, best[n - 1][1] + size)]
            options += [(best[j][0] + counts.cost[number[w[j:n]]], best[j][1] + 1) for j in range(max(0, n - longest), n) if w[j:n] in number]
            best.append(min(options, key=lambda x: (round(x[0], 7), x[1])))
        assert got[w] == best[-1][1]


@needs_pieces
def test_long_words_are_whole(spark, monkeypatch):
    df = spark.createDataFrame([(1, "sum 0123456789abcdef0123456789abcdef0123456789abcdef end")], "doc_id long, text string")
    assert pieces.token_counts(df, PIECES).first()["n_words"] == 3
    vocab = pieces.vocabulary(PIECES)
    number = {p: i for i, p in enumerate(vocab)}
    r = random.Random(8)
    words = sorted({pieces.MARK + "".join(r.choice(["the", "ing", "0", "f", "中", "文", "é", "\U0001f600", "/"]) for _ in range(n)) for n in (20, 38, 39, 40, 41, 42, 60, 81, 200)})
    assert sum(len(w) > pieces.LONGEST + 1 for w in words) > 5 and any(len(w) <= pieces.LONGEST + 1 for w in words)
    monkeypatch.setattr(pieces, "BLOCK", 37)
    counts = pieces.Counts(vocab)
    model = pieces.Languages.fit([(" ".join(w[1:] for w in words[::2]), "a"), (" ".join(w[1:] for w in words[1::2]), "b")], vocab)
    got, longest = counts.tokens(words), counts.pieces.longest
    for w in words:
        best, every = [(0.0, 0)], [np.zeros(2)]
        for n in range(1, len(w) + 1):
            ends = [(j, number[w[j:n]]) for j in range(max(0, n - longest), n) if w[j:n] in number]
            size = len(w[n - 1].encode())
            options = [(best[n - 1][0] + size * counts.byte_cost, best[n - 1][1] + size), *((best[j][0] + counts.cost[p], best[j][1] + 1) for j, p in ends)]
            best.append(min(options, key=lambda x: (round(x[0], 7), x[1])))
            every.append(np.logaddexp.reduce([every[n - 1] + model.unknown, *(every[j] + model.logs[p] for j, p in ends)], axis=0))
        assert got[w] == best[-1][1]
        share = np.exp(model.prior + every[-1] - np.logaddexp.reduce(model.prior + every[-1]))
        name, score = model.predict([w[1:]])[0]
        assert name == model.names[int(share.argmax())] and np.isclose(score, share.max())
    # The trie, made wide enough for these words, learns the same.
    monkeypatch.setattr(pieces, "LONGEST", 700)
    wide = pieces.Languages.fit([(" ".join(w[1:] for w in words[::2]), "a"), (" ".join(w[1:] for w in words[1::2]), "b")], vocab)
    assert np.allclose(wide.logs, model.logs) and pieces.Counts(vocab).tokens(words) == got


@needs_pieces
def test_languages_and_counts_on_odd_rows(docs, plain, empty):
    out = pieces.language_report(docs, PIECES).collect()
    assert len(out) == len(plain)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
    und = Counter(d for d, t in plain if not any(map(str.isalpha, t or "")))
    assert Counter(r["doc_id"] for r in out if r["lang_pred"] == "und") == und
    assert pieces.language_report(empty, PIECES).collect() == []
    kept = pieces.determined(docs, PIECES)
    assert kept.columns == docs.columns and kept.count() == len(plain) - sum(und.values())
    n = pieces.token_counts(docs, PIECES).collect()
    assert len(n) == len(plain) and all((r["n_tokens"] == 0) == (r["n_words"] == 0) for r in n)


@needs_pieces
def test_languages_are_told_apart(spark):
    r = random.Random(7)
    syllables = {"x": ["tha", "ing", "er"], "y": ["que", "eau", "oi"]}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang) for i in range(120) for lang in [("x", "y")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = pieces.language_report(df, PIECES).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert out and all(r["lang_pred"] == r["lang"] for r in out)


@needs_pieces
def test_rare_languages_are_learnt_and_none_drops_nothing(spark):
    rows = [(i, f"some words {i}", "y" if i % 100 == 0 else "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    of_y = df.filter((pieces.crc_mod("doc_id", 3) != 1) & (df["lang"] == "y")).count()
    drawn, sizes = pieces.learnt(df, 400)
    assert sum(lang == "y" for _, lang in drawn) == of_y == sizes["y"] > 10 and len(drawn) < 600
    none = spark.createDataFrame([(1, "clean words", None), (2, None, None), (3, "...", None), (4, "élan", None)], df.schema)
    assert sorted(r["doc_id"] for r in pieces.determined(none, PIECES).collect()) == [1, 4]


def brute_private(t):
    o = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    o["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    o["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and private.luhn(digits(m))]
    o["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return o


def test_base_patterns_as_plain_regular_expressions():
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice("ab@.1234567890-+ ()%_é٣") for _ in range(r.randint(0, 90)))
        assert private.find(t) == brute_private(t)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("write john dot doe at mail dot example dot com now", "email:6:46"),
        ("ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ ok", "email:0:13"),
        ("j​ohn@ma​il.com", "email:0:15"),
        ("call plus one two three four five six seven eight nine zero one", "phone:5:63"),
        ("10[.]2[.]3[.]4", "ip:0:14"),
        ("john (at) mail.com", "email:0:18"),
        ("she looked at the dot on the map, meet at noon", ""),
        ("a@b.c", "email:0:5"),
        ("", ""),
    ],
)
def test_disguises(text, spans):
    assert private.listed(private.detect(text)[1]) == spans


def test_bare_at_is_judged_by_itself():
    for rest in ("", " now", " and look for the dot on the map"):
        assert private.listed(private.detect("write to jane at corp.com" + rest)[1]) == "email:9:25"
        assert private.listed(private.detect("we met at noon.then left" + rest)[1]) == ""


def test_private_rows_and_masks(spark, docs, plain, empty):
    assert private.report(docs).count() == len(plain)
    assert private.report(empty).collect() == []
    df = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567", 9), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in private.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [PHONE]", 23), (2, None, None)]
    assert private.redact(docs).columns == docs.columns


def brute_contamination(rows, items, w=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = [(i, tuple(x[a : a + min(w, len(x))])) for i, t in items for x in [find(t)] if x for a in range(len(x) - min(w, len(x)) + 1)]
    out = []
    for d, t in rows:
        x, hit, ids = find(t), set(), set()
        for i, g in wins:
            for a in range(len(x) - len(g) + 1):
                if tuple(x[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    ids |= {str(i)} if i is not None else set()
        out.append((d, len(x), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(x)))
    return Counter(out)


def test_decontamination_as_brute_force(spark, docs, plain, empty, monkeypatch):
    body = [t for _, t in plain if t and len(t.split()) > 60]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    items = [(1, cut(body[0], 5, 13)), (2, cut(body[1], 0, 40) + " zz"), (10, cut(body[2], 3, 4)), (3, "short"), (4, None), (5, "..."), (None, cut(body[3], 9, 20)), (2, cut(body[4], 1, 14)), (7, "one TWO three one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(plain, items)
    assert Counter(tuple(r) for r in decontaminate.report(docs, bench).collect()) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in want.items() if not r[-1])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks
    assert Counter(tuple(r) for r in decontaminate.report(docs, bench).collect()) == want
    assert decontaminate.clean(docs, bench).count() == sum(n for r, n in want.items() if not r[-1])
    assert decontaminate.report(empty, bench).collect() == []
    assert decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


def test_decontamination_of_templated_items(spark, monkeypatch):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("a b A. c".split()) for _ in range(n))
    frame = " ".join(f"w{i}" for i in range(20))
    items = [(i % 50, text(r.randint(0, 16))) for i in range(80)] + [(100 + i, f"{frame} answer {i}") for i in range(40)]
    rows = [(i, text(r.randint(0, 60))) for i in range(60)] + [(None, f"x {frame} y"), (None, f"x {frame} y"), (70, frame), (71, None), (72, f"{frame} answer 3 " + "q " * 600)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, _k int").repartition(5)
    bench = spark.createDataFrame([(i, t, "") for i, t in items], "item_id long, text string, win string")
    want = brute_contamination(rows, items)
    for limit in (decontaminate.BLOCK_BYTES, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "BATCH", 7)
        assert Counter(tuple(x) for x in decontaminate.report(docs, bench).collect()) == want
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(n for x, n in want.items() if not x[-1])


def test_toxicity_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.standard_normal((5, 2 * toxicity.EACH))
    x[-1] = 0
    win, y = r.integers(0, 5, (6, toxicity.SPAN)), np.array([1, 0, 1, 0, 1, 1.0])
    g, dx = net.step(x, win, y)

    def loss():
        z = net.forward(x, win)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    def slope(a, i):
        was = a[i]
        a[i] = was + 1e-3
        up = loss()
        a[i] = was - 1e-3
        down = loss()
        a[i] = was
        return (up - down) / 2e-3

    for k, v in net.p.items():
        for i in (0, v.size // 2, v.size - 1):
            at = np.unravel_index(i, v.shape)
            assert np.isclose(g[k][at], slope(v, at), rtol=0.05, atol=2e-5)
    assert np.isclose(dx[1, 3], slope(x, (1, 3)), rtol=0.05, atol=2e-5)


def test_toxicity_learns_and_scores_all(spark, docs, plain):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioulmnt") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(1500):
        own = [word() for _ in range(r.randint(5, 120))]
        if i % 8 == 0:
            own.insert(r.randrange(len(own)), r.choice(["zorgh", "vexxed", "krud"]))
        rows.append((" ".join(own), int(i % 8 == 0)))
    net = toxicity.fit(rows[:1200], steps=80)
    said = net.predict([t.encode() for t, _ in rows[1200:]]) >= 0.5
    assert (said == np.array([y for _, y in rows[1200:]], bool)).mean() > 0.95
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (6, 1, None), (None, 1, 1), (18, 1, 0), (18, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.report(docs, labels).collect()
    assert len(out) == len(plain) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    assert toxicity.report(docs, labels.limit(0)).filter("score <> 0").count() == 0


def plain_score(net, text):
    """Operator 3's score of one text, word by word and window by window."""
    words = toxicity.WORD.findall(text.lower())
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v / (1 + abs(v))
    h, best = toxicity.STATES, net.low
    inputs = [net.inputs([w])[0].astype(float) for w in words]
    begins = range(max(1, len(words) - toxicity.SPAN + 1)) if words else []
    found = []
    for at in begins:
        own = inputs[at : at + toxicity.SPAN]
        states = np.zeros((len(own), 2 * h))
        for way in (0, 1):
            now = np.zeros(h)
            for t in range(len(own)) if way == 0 else reversed(range(len(own))):
                gx, gh = own[t] @ net.p["x"][way] + net.p["b"][way], now @ net.p["u"][way]
                z, r = (1 + soft(gx[:h] + gh[:h])) / 2, (1 + soft(gx[h : 2 * h] + gh[h : 2 * h])) / 2
                now = z * now + (1 - z) * soft(gx[2 * h :] + r * gh[2 * h :])
                states[t, way * h : way * h + h] = now
        if not len(own):
            continue
        share = np.exp(states @ net.p["a"])
        found.append(share / share.sum() @ states @ net.p["o"] + net.p["c"][0])
    return float(sig(net.scale * max(found, default=best) + net.shift))


def test_toxicity_scores_every_window(monkeypatch):
    net = toxicity.Network(2)
    r = np.random.default_rng(1)
    net.p = {k: r.standard_normal(v.shape).astype(np.float32) for k, v in net.p.items()}
    word = lambda: "".join(r.choice(list("aeiltn"), r.integers(1, 6)))
    sizes = [0, 1, 15, 16, 17, 31, 40, 0, 100, 16, 3]
    texts = [" ".join(word() for _ in range(n)).encode() for n in sizes]
    want = [plain_score(net, t) for t in texts]
    for block in (1, 7, 1000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(net.predict(texts), want, atol=1e-5)
    assert np.allclose(net.predict([b"", b""]), want[0]) and not len(net.predict([]))


def test_toxicity_query_as_brute_force(spark, docs, plain):
    labels = spark.createDataFrame([(3 * i, 1, int(i in (6, 7, 12))) for i in range(20)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(toxicity.labelled(docs, labels))
    want = sorted((-1 if d is None else d, round(plain_score(net, (t or "").encode()), 3)) for d, t in plain)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 3)) for r in toxicity.report(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) <= 0.002 for g, w in zip(got, want, strict=True))


def ends(word, number, longest):
    return [[(j, number[word[j:n]]) for j in range(max(0, n - longest), n) if word[j:n] in number] for n in range(1, len(word) + 1)]


@needs_pieces
def test_token_count_query_as_brute_force(docs, plain, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)  # tables begin anew in between
    vocab = pieces.vocabulary(PIECES)
    number = {p: i for i, p in enumerate(vocab)}
    counts = pieces.Counts(vocab)

    def tokens(w):
        best = [(0.0, 0)]
        for n, found in enumerate(ends(w, number, counts.pieces.longest), 1):
            size = len(w[n - 1].encode())
            options = [(best[n - 1][0] + size * counts.byte_cost, best[n - 1][1] + size), *((best[j][0] + counts.cost[p], best[j][1] + 1) for j, p in found)]
            best.append(min(options, key=lambda x: (round(x[0], 7), x[1])))
        return best[-1][1]

    known = {w: tokens(pieces.MARK + w) for w in {w for _, t in plain for w in (t or "").split()}}
    want = Counter((d, len((t or "").split()), sum(known[w] for w in (t or "").split())) for d, t in plain)
    assert Counter(tuple(r) for r in pieces.token_counts(docs, PIECES).collect()) == want


@needs_pieces
def test_language_query_as_brute_force(docs, plain):
    model = pieces.fitted(docs, PIECES)
    number = {p: i for i, p in enumerate(pieces.vocabulary(PIECES))}
    known = {}

    def forward(w):
        if w not in known:
            a = [np.zeros(len(model.names))]
            for n, found in enumerate(ends(w, number, model.pieces.longest), 1):
                a.append(np.logaddexp.reduce([a[n - 1] + model.unknown, *(a[j] + model.logs[p] for j, p in found)], axis=0))
            known[w] = a[-1]
        return known[w]

    got = pieces.language_report(docs, PIECES).collect()
    want = Counter()
    for d, t in plain:
        if not any(map(str.isalpha, t or "")):
            want[d, "und", 0.0] += 1
            continue
        total = model.prior + sum(forward(pieces.MARK + w) for w in t.lower().split())
        share = np.exp(total - np.logaddexp.reduce(total))
        want[d, model.names[int(share.argmax())], round(float(share.max()), 6)] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got) == want
