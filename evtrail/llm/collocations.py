"""Operator 12: phrase collocations by Apriori passes, one a length.

Pass 1 counts words, pass k phrases of k words. What pass k needs of the pass before is which phrases of k - 1 words
are frequent: their hashes as a bitmap (16 bits a phrase, 16 MB at most, at any size of the corpus) are sent to all
workers, and only phrases whose two overlapping subphrases are in it are emitted. A hash that meets by chance emits a
phrase too many; counts are by the phrase itself, so results don't depend on it. Counts are summed in a slice, then in
a task, then by key, so no common phrase is a hot key. Cuts are scored from the tables of all levels.

Everything is per lang; a null lang counts as 'und', null and empty texts have no words. Repeated rows count again.
Ties go as the order says: score, a, phrase. An empty table, or one without a frequent phrase, gives no rows. Columns
other than text and lang aren't read. A very long text is gone through in chunks that overlap by k - 1 words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_array, bitmap_rows, raw, slices, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, every piece's end as a full stop (which no word holds), tabs as blanks.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(BREAKS) + b" ")
#: Bytes of text handled at once, and parts into which a language is dealt for its best phrases.
CHUNK, PARTS = 4 << 20, 64
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
ROW = "lang string, p string, f long"


def _chunks(text: bytes) -> Iterator[bytes]:
    """text in parts of about CHUNK bytes, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _hashes(own: np.ndarray, size: int) -> np.ndarray:
    """The hash of each phrase of size words, from those of the words."""
    out = own
    for i in range(1, size):
        out = out[:-1] * MULTIPLY + own[i:] if len(out) > 1 else out[:0]
    return out


def _windows(words: list[bytes], k: int, seed: int, bits: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """The distinct phrases of k words whose subphrases' hashes are in bits, with their counts. A word b"." ends a piece."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    end = number[b"."]
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if k == 1:
        at = np.flatnonzero(ids != end)
    else:
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in number), np.uint64, len(number))[ids]
        hashes = _hashes(own, k - 1)
        ends = np.concatenate([[0], np.cumsum(ids == end)])
        whole = ends[k - 1 :][: len(hashes)] == ends[: len(hashes)]
        place = hashes & np.uint64(8 * len(bits) - 1)
        known = whole & ((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1)
        at = np.flatnonzero(known[:-1] & known[1:])
    code = ids[at]
    for i in range(1, k):
        if i > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[at + i]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [b" ".join(words[i : i + k]) for i in at[first].tolist()], counts


def _counted(docs: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, p, f): phrases of k words with their counts. With k = 1 the empty phrase counts all words of its lang."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        before: list[bytes] = []
        for part in _chunks(b" . ".join(texts).translate(PLAIN).replace(b".", b" . ")):
            words = before + part.split()
            phrases, counts = _windows(words, k, xxhash.xxh64_intdigest(lang), sent.value)
            if k == 1:
                phrases, counts = [*phrases, b""], np.append(counts, counts.sum())
            before = words[len(words) - k + 1 :]
            columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "p", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", CHUNK):
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), raw(batch, "_t"), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                yield from rows(lang, texts)

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")
    found = docs.select(lang, docs["text"].cast("string").alias("_t")).mapInArrow(run, ROW)
    return found.groupBy("lang", "p").agg(F.sum("f").alias("f"))


def _bits(phrases: DataFrame) -> np.ndarray:
    """The bitmap of the phrases' hashes. Hashes are made here, of frequent phrases, so that counts travel without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, p in zip(batch.column("lang").to_pylist(), raw(batch, "p"), strict=True):
                seed, own = xxhash.xxh64_intdigest(lang), p.split(b" ")
                found.append(_hashes(np.array([xxhash.xxh64_intdigest(w, seed) for w in own], np.uint64), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    return bitmap_array(*bitmap_rows(phrases.select("lang", "p").mapInArrow(run, "h long"), "h"))


def levels(docs: DataFrame, least: int = 100, longest: int = 5) -> list[DataFrame]:
    """Of each length from 1 to longest the phrases that occur least times, as tables (lang, p, f); the first also has each lang's number of words, as the count of the empty phrase."""
    out = [written(_counted(docs, 1, None).filter((F.col("f") >= least) | (F.col("p") == "")))]
    for k in range(2, longest + 1):
        out.append(written(_counted(docs, k, _bits(out[-1].filter("p <> ''"))).filter(F.col("f") >= least)))
    return out


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) of numbers of up to 16 digits, exact."""
    wide = {name: c.cast("decimal(16,0)") for name, c in (("a", a), ("n", n), ("l", left), ("r", right))}
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"]), wide["l"] * wide["r"])


def collocations(docs: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of 2 to longest words at their lowest-scoring cut.

    A phrase goes if a longer one that holds it occurs as often. Of all that hold it, one is longer by just one word and
    occurs as often too, so these alone are looked at.
    """
    counted = levels(docs, least, longest)
    every = counted[0]
    for level in counted[1:]:
        every = every.unionByName(level)
    phrases = None
    for k, level in enumerate(counted[1:], 2):
        own = level.select("lang", "p", "f", F.lit(k).alias("k"))
        phrases = own if phrases is None else phrases.unionByName(own)
    from_second = F.expr("substring(p, length(substring_index(p, ' ', 1)) + 2)")
    inner = phrases.filter("k > 2").select("lang", F.explode(F.array(F.expr("substring_index(p, ' ', k - 1)"), from_second)).alias("p"), "f")
    left = phrases.join(inner, ["lang", "p", "f"], "left_anti")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("p1", F.expr("substring_index(p, ' ', cut)")).withColumn("p2", F.expr("substring(p, length(p1) + 2)"))
    cuts = cuts.join(every.select("lang", F.col("p").alias("p1"), F.col("f").alias("l")), ["lang", "p1"])
    cuts = cuts.join(every.select("lang", F.col("p").alias("p2"), F.col("f").alias("r")), ["lang", "p2"])
    cuts = cuts.join(counted[0].filter("p = ''").select("lang", F.col("f").alias("n")), "lang")
    scored = cuts.select("lang", "p", "f", "n", F.struct(cut_score(F.col("f"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r").alias("s"))
    lowest = scored.groupBy("lang", "p").agg(F.min("s").alias("s"), F.max("f").alias("a"), F.max("n").alias("n"))
    return lowest.select("lang", F.col("p").alias("phrase"), "a", "s.l", "s.r", "n", "s.score")


def best(phrases: DataFrame, most: int = 2000) -> DataFrame:
    """Each lang's first phrases with their rank. A lang is ranked by parts first, so no task holds all its phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return best(collocations(docs))
