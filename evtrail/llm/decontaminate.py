"""Operator 8: benchmark decontamination by winnowing.

Of each run of W - K + 1 successive k-grams the one with the least hash is kept, on both sides, so that any shared run
of W words has a kept k-gram in common. A kept k-gram of a document that the benchmark also keeps is extended to the
windows it was kept for, and these are looked up among the benchmark's; windows are compared as words, never as
hashes, and overlapping ones make up the shared run. However many items hold a k-gram, it leads to W - K + 1 windows
at most. An item of fewer than W words is one window; all k-grams of its length are looked up.

A benchmark of up to BLOCK_BYTES of text goes to all workers and meets every document in one pass. A larger one is a
table of distinct windows, joined with the documents' windows by their words; what the documents shuffle are the
windows around k-grams that pass a bitmap of the benchmark's, of 16 MB at any size.

Null and empty texts have no words and are never hit. Items without words take no part; an item without an id
hits words but isn't counted or named, several with one id count once. A document that is repeated gets the same
row again. An empty benchmark leaves every document clean; an empty documents table gives no rows. Other columns,
whatever their names, aren't read by the report.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, plain_id, raw, slices, written

#: Bytes of benchmark text, with 64 for each item, that are sent to all workers at most.
BLOCK_BYTES = 4 << 20
#: Bits that stand for the kept k-grams of a larger benchmark, in rows of 2^15.
BITS, ROW_BITS = 27, 15
#: Windows in a batch of output.
BATCH = 1 << 16
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The number of words that no item holds.
OTHER = -1


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive words, given as numbers."""
    n = max(0, len(words) - k + 1)
    mixed = words.astype(np.uint64) * MIX
    return _folded((mixed[i : i + n] for i in range(k)), n)


def _folded(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for x in columns:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x
    return out ^ (out >> np.uint64(32))


def _grams_at(words: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """The hashes of those k successive words that begin there."""
    return _folded((words[begins + i].astype(np.uint64) * MIX for i in range(k)), len(begins))


def _kept(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash, the leftmost of equals, of each w successive ones."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    return np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))


def _around(grams: np.ndarray, w: int, k: int, known: np.ndarray) -> np.ndarray:
    """The first words of all windows around those kept k-grams that are known (a truth value for each k-gram)."""
    at = _kept(grams, w - k + 1)
    at = at[known[at]]
    begins = np.unique((at[:, None] - np.arange(w - k + 1)).ravel())
    return begins[(begins >= 0) & (begins <= len(grams) + k - 1 - w)]


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


class Windows:
    """The distinct windows of one length, each with the items that hold it."""

    def __init__(self, rows: np.ndarray, items: np.ndarray) -> None:
        """rows: the words of each window, as numbers; items: the place of the item of each."""
        words, which = np.unique(rows, axis=0, return_inverse=True)
        owners = np.unique(np.stack([which.ravel(), items]), axis=1)
        cuts = np.searchsorted(owners[0], np.arange(len(words) + 1))
        size = rows.shape[1]
        hashes = _grams_at(words.ravel(), np.arange(len(words)) * size, size)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], words[order]
        self.items = [tuple(owners[1, cuts[i] : cuts[i + 1]].tolist()) for i in order.tolist()]

    def find(self, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(first word, items) of each of the windows that begin there and are among these."""
        size = self.words.shape[1]
        hashes = _grams_at(words, begins, size)
        low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        for i in np.flatnonzero(low < high).tolist():
            a = int(begins[i])
            for c in range(int(low[i]), int(high[i])):
                if (self.words[c] == words[a : a + size]).all():
                    yield a, self.items[c]


class Index:
    """The windows and kept k-grams of a benchmark that fits a worker."""

    def __init__(self, items: list[tuple[int | None, bytes]], w: int, k: int) -> None:
        self.w, self.k = w, k
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        kept = []
        for n, (_, text) in enumerate(items):
            own = np.array([self.number.setdefault(x, len(self.number)) for x in words_of(text)], np.int32)
            if not len(own):
                continue
            size = min(w, len(own))
            parts.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(own, size), n))
            if size == w:
                grams = _grams(own, k)
                kept.append(grams[_kept(grams, w - k + 1)])
        self.kept = np.unique(np.concatenate(kept)) if kept else None
        self.tables = {size: Windows(np.concatenate([x for x, _ in own]), np.repeat([n for _, n in own], [len(x) for x, _ in own])) for size, own in parts.items()}

    def match(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text: its words, the parts of them that are hit, and the ids of the items that hit it."""
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(x) for x in split])
        words = np.fromiter((self.number.get(x, OTHER) for own in split for x in own), np.int64, int(ends[-1]) if len(ends) else 0)
        text = np.repeat(np.arange(len(split)), [len(x) for x in split])
        parts: dict[int, tuple[list[tuple[int, int]], set[tuple[int, ...]]]] = {}
        for size, table in self.tables.items():
            if size == self.w:
                grams = _grams(words, self.k)
                begins = _around(grams, self.w, self.k, _among(grams, self.kept))
            else:
                begins = np.arange(len(words) - size + 1)
            begins = begins[text[begins] == text[begins + size - 1]]
            for a, items in table.find(words, begins):
                d = int(text[a])
                begin = int(ends[d - 1]) if d else 0
                spans, lists = parts.setdefault(d, ([], set()))
                spans.append((a - begin, a - begin + size))
                lists.add(items)
        for d, own in enumerate(split):
            spans, lists = parts.get(d, ([], ()))
            yield len(own), _union(spans), sorted({self.ids[n] for x in lists for n in x} - {None})


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _small(items: DataFrame) -> list[tuple[int | None, bytes]] | None:
    """The items, if they are of bounded size."""
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    return [(r["i"], r["t"].encode()) for r in items.collect()] if size <= BLOCK_BYTES else None


_built: dict[str, Index] = {}


def _index(name: str, sent, w: int, k: int) -> Index:  # noqa: ANN001
    """The index of a block's broadcast, built once in each worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(sent.value, w, k)
    return _built[name]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _found(docs: DataFrame, items: list[tuple[int | None, bytes]], w: int, k: int) -> DataFrame:
    """One pass: (_k, _x, n, spans, items) for each row of docs."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent, w, k)
        for b in slices(batches, "_t"):
            n, spans, ids = zip(*index.match(raw(b, "_t")), strict=True)
            flat = [[x for s in own for x in s] for own in spans]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_x"), pa.array(n, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], ["_k", "_x", "n", "spans", "items"])

    return keyed(docs).mapInArrow(run, "_k long, _x long, n long, spans array<int>, items array<long>")


def _rows(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, count, names, bad = [], [], [], []
            for n, spans, items in zip(*(b.column(c).to_pylist() for c in ("n", "spans", "items")), strict=True):
                total = sum(e - a for a, e in _union(list(zip(spans[::2], spans[1::2], strict=True))))
                ids = sorted(map(str, set(items)))
                hit.append(total)
                count.append(len(ids))
                names.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                bad.append(total > 0 and 20 * total >= n)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_x"), b.column("n"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(names, pa.string()), pa.array(bad, pa.bool_())], ["_k", "_x", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(run, "_k long, _x long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _hashed(split: list[list[bytes]]) -> np.ndarray:
    """A number for each word, the same in every task."""
    number: dict[bytes, int] = {}
    for own in split:
        for x in own:
            if x not in number:
                number[x] = xxhash.xxh64_intdigest(x)
    return np.fromiter((number[x] for own in split for x in own), np.uint64, sum(map(len, split)))


def _windows(items: DataFrame, w: int, k: int) -> DataFrame:
    """(win, size, f, items): each distinct window of the benchmark, its kept k-gram and the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            for i, text in zip(b.column("i").to_pylist(), raw(b, "t"), strict=True):
                own = words_of(text)
                if not own:
                    continue
                size = min(w, len(own))
                grams = _grams(_hashed([own]), k if size == w else size)
                first = np.zeros(1, np.int64)
                if size == w:  # of a window's k-grams the least, the leftmost of equals, as in _kept
                    first = np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(32), w - k + 1).argmin(axis=1)
                    first += np.arange(len(first))
                for c in range(0, len(first), BATCH):
                    own_first = first[c : c + BATCH]
                    wins = [b" ".join(own[a : a + size]) for a in range(c, c + len(own_first))]
                    n = len(wins)
                    yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array([size] * n, pa.int32()), pa.array(grams[own_first].view(np.int64)), pa.array([i] * n, pa.int64())], ["win", "size", "f", "item"])

    rows = items.mapInArrow(run, "win binary, size int, f long, item long")
    return rows.groupBy("win", "size", "f").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which of 2^BITS bits a kept k-gram sets: at most 2^(BITS - ROW_BITS) rows of 4 KB each."""
    bit = F.col("f").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = windows.select(F.shiftright(bit, ROW_BITS).alias("r"), bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("p")).groupBy("r").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << (BITS - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for r in rows.collect():
        out[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _set(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams & np.uint64((1 << BITS) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _candidates(docs: DataFrame, windows: DataFrame, w: int, k: int) -> DataFrame:
    """(_k, _x, a, b, win): the windows of documents around k-grams that the benchmark may keep."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            split = [words_of(t) for t in raw(batch, "_t")]
            flat = [x for own in split for x in own]
            words, text = _hashed(split), np.repeat(np.arange(len(split)), [len(x) for x in split])
            begin = np.cumsum([0, *(len(x) for x in split)])
            for size in sizes:
                grams = _grams(words, k if size == w else size)
                known = _set(sent.value, grams)
                at = _around(grams, w, k, known) if size == w else np.flatnonzero(known)
                at = at[text[at] == text[at + size - 1]]
                for c in range(0, len(at), BATCH):
                    own = at[c : c + BATCH]
                    rows, first = text[own], (own - begin[text[own]]).astype(np.int32)
                    wins = pa.array([b" ".join(flat[a : a + size]) for a in own.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(rows)), batch.column("_x").take(pa.array(rows)), pa.array(first), pa.array(first + np.int32(size)), wins], ["_k", "_x", "a", "b", "win"])

    return keyed(docs).mapInArrow(run, "_k long, _x long, a int, b int, win binary")


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_x"), pa.array([len(words_of(t)) for t in raw(b, "_t")], pa.int64())], ["_k", "_x", "n"])

    return keyed(docs).mapInArrow(run, "_k long, _x long, n long")


def _met(docs: DataFrame, items: DataFrame, w: int, k: int) -> DataFrame:
    """_found for a benchmark of any size: windows meet by a join, whatever the benchmark's size in two passes over docs."""
    windows = written(_windows(items, w, k))
    hits = _candidates(docs, windows, w, k).join(windows.select("win", "items"), "win").groupBy("_k", "_x")
    # Windows of one run mostly share a list of items, so the distinct lists are few.
    lists = hits.agg(F.collect_set(F.array("a", "b")).alias("spans"), F.collect_set("items").alias("items"))
    flat = lists.select("_k", "_x", F.flatten("spans").alias("spans"), F.array_distinct(F.flatten("items")).alias("items"))
    none = [F.coalesce(F.col("spans"), F.array().cast("array<int>")).alias("spans"), F.coalesce(F.col("items"), F.array().cast("array<long>")).alias("items")]
    return _counted(docs).join(flat, ["_k", "_x"], "left").select("_k", "_x", "n", *none)


def contamination(docs: DataFrame, benchmark: DataFrame, w: int = 13, k: int = 5) -> DataFrame:
    """(_k, _x, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    small = _small(_items(benchmark))
    return _rows(_met(docs, _items(benchmark), w, k) if small is None else _found(docs, small, w, k))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(plain_id(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, w: int = 13, k: int = 5) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    small = _small(_items(benchmark))
    if small is not None:  # one pass knows all hits of a row
        sent, name = docs.sparkSession.sparkContext.broadcast(small), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent, w, k)
            for b in slices(batches, "text"):
                hits = [(n, sum(e - a for a, e in spans)) for n, spans, _ in index.match(raw(b, "text"))]
                yield b.filter(pa.array([not (hit and 20 * hit >= n) for n, hit in hits]))

        return docs.mapInArrow(run, docs.schema)
    bad = _rows(_met(docs, _items(benchmark), w, k)).filter("contaminated").select("_k", "_x").distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(bad, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == bad["_k"]) & (F.xxhash64(text) == bad["_x"]), "left_anti")
