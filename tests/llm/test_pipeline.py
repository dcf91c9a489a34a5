import hashlib
import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from evtrail.llm import bpe, pieces

needs = pytest.mark.skipif(not (os.path.exists(bpe.vocabulary_path()) and os.path.exists(pieces.vocabulary_path())), reason="no vocabulary")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    r = random.Random(11)
    kinds = {"en": ["the", "ing", "er", "and", "th"], "fr": ["que", "eau", "oi", "les", "ent"]}
    own = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, own(lang, 60), lang) for i in range(40) for lang in [("en", "fr")[i % 2]]]
    item = own("en", 30)
    rows += [(100, rows[0][1], "en"), (101, rows[0][1].upper(), "fr"), (102, own("fr", 50), "en")]  # copies; a wrong label
    rows += [(110, None, "en"), (111, "... 123 !!", "fr"), (112, "", None)]  # no language
    rows += [(120, item + " " + own("en", 40), "en"), (121, own("en", 700) + " " + " ".join(item.split()[:14]), "en")]  # half of it, and a fiftieth, is the benchmark's
    rows += [(130, own("fr", 40) + " mail jane.roe@example.org or +1 (555) 123-4567 now", "fr")]
    return rows, item


@needs
def test_stages_and_run_as_planted(spark, tmp_path):
    rows, item = texts()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = spark.createDataFrame(stage(spark, own, str(tmp_path)).collect(), SCHEMA)
        assert own.columns == docs.columns
        ids.append({r["doc_id"] for r in own.collect()})
    every = {i for i, _, _ in rows}
    assert ids[0] == every - {110, 111, 112}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {120}
    assert ids[3] == ids[2]
    last = {r["doc_id"]: r for r in own.collect()}
    assert last[102]["lang"] == "fr"  # the predicted one
    assert last[130]["text"].endswith(" mail [EMAIL] or [PHONE] now") and last[130]["n_chars"] == len(last[130]["text"])
    assert all(last[i]["text"] == t for i, t, _ in rows if i in last and i != 130)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for i, r in last.items():
        found = lib.encode(r["text"], add_special_tokens=False).ids
        want[i, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(lib.decode(found, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


@needs
def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@needs
def test_language_stage_with_odd_columns(spark):
    rows = [(1, "some words", "en", "x", 1), (2, None, "en", "y", 2), (None, "other words", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, found int")
    out = pieces.determined(docs, pieces.vocabulary_path())
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"] or 0, r["found"] or 0) for r in out.collect()) == [(0, 0), (1, 1)]
