import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, _k string, fp int"


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    out = [None, "", " ", "...", "short", "A b  C\td", passage, passage, passage + " tail", "head " + passage + " end"]
    for _ in range(12):
        out.append(" ".join(word() for _ in range(r.randint(0, 150))))
    out += [out[-1], out[-2] + " x", "x " * 300, "ab" * 400, "one two three " * 40]
    long = " ".join(word() for _ in range(3000))
    out += [long, long[: len(long) // 2] + " " + passage, passage[:200] + "\n" + passage]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else "fr", "s", len(t or ""), "x", "k", i) for i, t in enumerate(texts())]
    rows += [rows[12], (None, rows[6][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) rows, with None for null ids."""
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
