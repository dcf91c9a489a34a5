"""Operator 11: spelling variants by rolling-hash deletions.

Words are counted first. A word's deletion keys, hashes of it with one code point left out (and of the whole word, with
none left out), come from prefix and suffix sums of a polynomial, for all words of a batch at once. Two words are near
if they share a left-out string: one is that string and the other has a code point more, or both have another code
point at one place. Keys are dealt by their leading bits into parts of about PART keys, a task sorts a part, and where
keys agree the left-out strings themselves are compared, so that a collision of hashes joins nothing.

No pairs are emitted: in a group of words with one place open (90 letters at most, so 90 words) each word's near words
are the others, and its best is the group's first or second; a string and the words with one code point more likewise.
A word gets a row (how many, best) from each of its groups, and these are summed. A long word's keys carry no text
until another word has met them, so that a word of a million letters costs a million keys, not their strings.

Null texts have no words, a null doc_id counts as the empty text in a word's hash. Repeated rows count again. Ties of the
best near word go to the smallest in code-point order. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, written

#: Letters, and those from À to ÿ, so that a code point of a word is a byte of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys of a part; code points beyond which a word's keys travel without it; words a task counts before it lets go of them; code points of a text whose words are listed.
PART, LONG, HELD, WHOLE = 1 << 16, 64, 1 << 18, 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CODES = np.random.default_rng(11).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def noisy(doc_id: int | None, run: str, every: int = 31) -> str:
    """The run, or where every divides the checksum of id and run, the run without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): the words of at least shortest code points that occur at least least times."""
    pattern = re.compile(f"[{LETTERS}]{{{shortest},}}")
    runs, every_run = pattern.findall, pattern.finditer

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(batches, "_t"):
            for doc_id, text in zip(batch.column("_d").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                found = runs(text or "") if len(text or "") < WHOLE else (m[0] for m in every_run(text))
                for own, n in Counter(found).items():
                    word = noisy(doc_id, own.lower() if own.isascii() else own.translate(LOWER))
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) > HELD:
                yield batch_of(held)
                held = Counter()
        yield batch_of(held)

    found = docs.select(docs["doc_id"].cast("long").alias("_d"), docs["text"].cast("string").alias("_t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key) of each string that leaves one code point out, and of each whole word (place -1). Of equal neighbours the first is left out."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    begin = ends - size
    flat = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - begin[word]
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, BASE, np.uint64)) * INVERSE
    terms = CODES[flat] * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    prefix, whole = sums[:-1] - sums[begin][word], sums[ends] - sums[begin]
    # What follows the code point moves one place down: its sum is divided by the base.
    without = prefix + (whole[word] - prefix - terms) * INVERSE
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (word[1:] != word[:-1])
    keys = np.concatenate([whole, without[first]])
    # The leading bits, by which keys are dealt, depend on all others after this.
    keys = (keys ^ (keys >> np.uint64(32))) * BASE
    return np.concatenate([np.arange(len(words)), word[first]]), np.concatenate([np.full(len(words), -1), place[first]]), keys ^ (keys >> np.uint64(29))


def _keyed(words: DataFrame, column: str, carried: bool, parts: int, mask: int) -> DataFrame:
    """(part, key, place, word or id, n) of each deletion key."""
    schema = f"part int, key long, place int, {'word binary' if carried else 'id long'}, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 1 << 16):
            texts = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            word, place, key = deletion_keys(texts)
            key &= np.uint64(mask)
            part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            own = [pa.array(texts, pa.binary()) if carried else batch.column("id"), batch.column("n")]
            at = pa.array(word)
            for a in range(0, len(word), 1 << 17):
                cut = slice(a, a + (1 << 17))
                columns = [pa.array(part[cut].astype(np.int32)), pa.array(key[cut].view(np.int64)), pa.array(place[cut].astype(np.int32)), *[c.take(at[cut]) for c in own]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "key", "place", "word" if carried else "id", "n"])

    return words.select("word", "id", "n").mapInArrow(run, schema)


def _best_others(rows: list[int], rank: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, tuple[int, bytes]]]:
    """(row, how many others, the best other) for each of several rows that are near each other."""
    a, b = sorted(rows, key=rank.__getitem__)[:2]
    for i in rows:
        yield i, len(rows) - 1, rank[b if i == a else a]


def _part(table: pa.Table) -> pa.Table:
    """A part's keys in order; what words with one left-out string say of each other."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    meets = np.zeros(len(key) + 1, bool)
    meets[1:-1] = key[1:] == key[:-1]
    order = order[meets[1:] | meets[:-1]]
    rows = table.take(pa.array(order))
    words, place, n, key = rows.column("word").to_pylist(), rows.column("place").to_pylist(), rows.column("n").to_pylist(), rows.column("key").to_pylist()
    rank = [(-c, w) for c, w in zip(n, words, strict=True)]
    out: list[tuple[int, int, tuple[int, bytes]]] = []
    at = 0
    while at < len(key):
        stop = at + 1
        while stop < len(key) and key[stop] == key[at]:
            stop += 1
        by_string: dict[bytes, list[int]] = {}
        for i in range(at, stop):
            w, p = words[i], place[i]
            by_string.setdefault(w if p < 0 else w[:p] + w[p + 1 :], []).append(i)
        for own in by_string.values():
            if len(own) > 1:
                out += _said(own, words, place, rank)
        at = stop
    columns = [pa.array([words[i] for i, _, _ in out], pa.binary()), pa.array([c for _, c, _ in out], pa.int64()), pa.array([-b[0] for _, _, b in out], pa.int64()), pa.array([b[1] for _, _, b in out], pa.binary())]
    return pa.Table.from_arrays(columns, ["word", "near", "best_n", "best"])


def _said(own: list[int], words: list[bytes], place: list[int], rank: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, tuple[int, bytes]]]:
    """own: rows that share a left-out string: at most one is that string, the others have a code point more."""
    longer = [i for i in own if place[i] >= 0]
    if len(longer) < len(own) and longer:
        string = next(i for i in own if place[i] < 0)
        yield string, len(longer), min(rank[i] for i in longer)
        for i in longer:
            yield i, 1, rank[string]
    if len(longer) > 1:
        # A code point that stands in a row of its like may be left out at each place of the row.
        open_at: dict[int, list[int]] = {}
        for i in longer:
            w, p = words[i], place[i]
            letter, q = w[p], p
            while q < len(w) and w[q] == letter:
                open_at.setdefault(q, []).append(i)
                q += 1
        for rows in open_at.values():
            if len(rows) > 1:
                yield from _best_others(rows, rank)


def near(words: DataFrame, mask: int = (1 << 64) - 1) -> DataFrame:
    """(word, n, n_near, best_n, best) for each of words (word, n, id), a written table. mask: bits of the keys that are used."""
    parts = max(1, int(words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // PART)
    keys = _keyed(words.filter(F.length("word") <= LONG), "word", True, parts, mask)
    if words.filter(F.length("word") > LONG).head(1):
        long = written(_keyed(words.filter(F.length("word") >= LONG), "id", False, parts, mask))
        met = long.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
        texts = words.filter(F.length("word") > LONG).select("id", F.encode("word", "ISO-8859-1").alias("word"))
        keys = keys.unionByName(long.join(met, "key").join(texts, "id").select("part", "key", "place", "word", "n"))
    said = keys.groupBy("part").applyInArrow(_part, "word binary, near long, best_n long, best binary")
    best = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))
    said = said.select(F.decode("word", "ISO-8859-1").alias("word"), F.lit(None).cast("long").alias("n"), "near", F.when(F.col("near") > 0, best).alias("b"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<n:bigint,w:binary>").alias("b"))
    summed = every.unionByName(said).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    return summed.select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.decode("b.w", "ISO-8859-1").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. Each round goes twice as far; forms rise in n, so none comes back."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_written(now)
        now = after
        if not after.filter("moved").head(1):
            return after.select("word", "root")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its near word of largest n, if times its n at least."""
    words = written(counts(docs, shortest, least).withColumn("id", F.monotonically_increasing_id()))
    is_form = F.col("best_n") >= times * F.col("n")
    found = written(near(words).select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(docs)
