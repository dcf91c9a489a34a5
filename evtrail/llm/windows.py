"""Repeated windows of T tokens, found in passes from coarse groups of window starts to single ones.

Each window start is led to an anchor: the place of least hash among the w places from the start on. As the anchor
follows from the window's own tokens, equal windows have anchors at equal offsets. Successive starts with one anchor
form a run, a row of the pass, with two keys: f, of the T - w + 1 tokens from the anchor on, which all windows of
the run hold; and u, of all tokens that the run's windows cover.
- Windows in runs of different f differ: a run alone with its f holds no repeated window and is dropped.
- All windows of runs that agree in f and u are equal in turn: they are settled as they stand.
- Where one f has several u, the first run of each u goes on to the next pass, with a smaller w.
With w = 1 a run is a single window, f and u are both keys of just that window, and every window is settled.
Keys are hashes of 64 bits each, so that a settled run agrees in 128 bits.

Text that repeats itself at short range (one letter, lines of dashes, a word again and again) has many equal runs one
right behind the other: these are one row, over all their starts, with their number in times.

Rows of a pass are counted and joined by key; no group of equal keys is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, joined, raw, slices, written

MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
ROW = "f long, u long, _k long, _x long, lo int, n int, times int"
#: Runs of at most PERIOD starts are compared with the one before by their tokens, where a slice has SERIES such
#: neighbours; others by their keys. The rows are the same.
PERIOD, SERIES = 32, 1000


@dataclass
class Tokens:
    """The tokens of several texts in a row: bytes, each token's begin and end there, each text's end in tokens, a hash of each token place."""

    whole: bytes
    begin: np.ndarray | None
    stop: np.ndarray | None
    ends: np.ndarray
    hashes: np.ndarray

    def bytes_of(self, first: np.ndarray, after: np.ndarray) -> tuple[list[int], list[int]]:
        if self.begin is None:
            return first.tolist(), after.tolist()
        return self.begin[first].tolist(), self.stop[after - 1].tolist()

    def codes(self) -> np.ndarray:
        """A number for each token, the same for equal tokens alone."""
        if self.begin is None:
            return np.frombuffer(self.whole, np.uint8)
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.whole.split(b" ")), np.int64, len(self.begin))


def byte_tokens(batch: pa.RecordBatch) -> Tokens:
    whole, ends = joined(batch, "_t")
    eight = np.ndarray((len(whole),), "<u8", whole + bytes(8), strides=(1,))
    # Places where one byte fills all eight rank last: in lines of dashes it is the line ends that windows are led to.
    flat = (eight == (eight & np.uint64(255)) * np.uint64(0x0101010101010101)).astype(np.uint64)
    return Tokens(whole, None, None, ends, ((eight * MIX) >> np.uint64(33)) | (flat << np.uint64(31)))


def word_tokens(batch: pa.RecordBatch) -> Tokens:
    split = [t.split() for t in raw(batch, "_t")]
    ends = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=ends[1:])
    words = [w for own in split for w in own]
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(words) else stop
    crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return Tokens(b" ".join(words), begin, stop, ends, (crc * MIX) >> np.uint64(32))


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each place, that of the least hash, the leftmost of equals, among the w places from it on."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    least = (hashes << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    return (least & LOW).astype(np.int64)


def _between(first: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
    """True at the places that some part [first, after) holds."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, after, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(tokens: Tokens, depth: int, w: int, only: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of each run of window starts, of those that only holds, if given."""
    ends = tokens.ends
    long = np.flatnonzero(np.diff(ends) >= depth)
    n = int(ends[-1])
    if not len(long):
        return (np.zeros(0, np.int64),) * 3
    starts = _between(ends[long], ends[long + 1] - depth + 1, n)
    if only is not None:
        starts &= _between(*only, n)
    at = np.flatnonzero(starts)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    anchor = anchors(tokens.hashes, w)[at]
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(at)]]) - 1
    return anchor[first], at[first], at[last]


def repeats_before(tokens: Tokens, depth: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True for runs known to hold the same tokens as the run that they follow without a gap: tokens agree with those a run's length later."""
    n = last - first + 1
    same = np.zeros(len(n), bool)
    next_to = np.flatnonzero((n[1:] == n[:-1]) & (first[1:] == last[:-1] + 1) & (n[1:] <= PERIOD))
    often = np.flatnonzero(np.bincount(n[next_to], minlength=1) >= SERIES)
    codes = tokens.codes() if len(often) else None
    for period in often.tolist():
        before = next_to[n[next_to] == period]
        differ = np.concatenate([[0], np.cumsum(codes[:-period] != codes[period:])])
        same[before + 1] = differ[last[before] + depth] == differ[first[before]]
    return same


def _open(batch: pa.RecordBatch, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts named in the column iv (start, number, start, ...), as places in the row of texts."""
    iv = batch.column("iv")
    flat = iv.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(iv.offsets.to_numpy()) // 2)
    first = flat[::2] + ends[doc]
    return first, first + flat[1::2]


def pass_rows(docs: DataFrame, read: Callable[[pa.RecordBatch], Tokens], depth: int, w: int, keep: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """The runs of one pass over docs (_k, _x, _t and, from the second pass on, iv); keep, made in each task, picks runs by f."""
    later = "iv" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = keep() if keep else None
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "_t"):
            t = read(batch)
            anchor, first, last = runs(t, depth, w, _open(batch, t.ends) if later else None)
            if not len(first):
                continue
            view = memoryview(t.whole)
            new = np.flatnonzero(~repeats_before(t, depth, first, last))
            times = np.diff(np.append(new, len(first)))
            anchor, first, last = anchor[new], first[new], last[new]
            f = np.array([digest(view[a:b]) for a, b in zip(*t.bytes_of(anchor, anchor + depth - w + 1), strict=True)], np.uint64)
            if picks is not None:
                some = picks(f)
                f, first, last, times = f[some], first[some], last[some], times[some]
            if not len(f):
                continue
            u = np.array([digest(view[a:b], 1) for a, b in zip(*t.bytes_of(first, last + depth), strict=True)], np.uint64)
            n = (last - first + 1) * times
            new = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (u[1:] != u[:-1]) | (first[1:] != first[:-1] + n[:-1])))
            times, n = np.add.reduceat(times, new), np.add.reduceat(n, new)
            f, u, first = f[new], u[new], first[new]
            doc = np.searchsorted(t.ends, first, side="right") - 1
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(u.view(np.int64)), batch.column("_k").take(rows), batch.column("_x").take(rows), pa.array((first - t.ends[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))], ["f", "u", "_k", "_x", "lo", "n", "times"])

    return docs.mapInArrow(run, ROW)


def repeated_f(rows: DataFrame) -> DataFrame:
    """The rows whose f occurs more than once, written."""
    often = written(rows.groupBy("f").agg(F.sum("times").alias("c")).filter("c > 1").select("f"))
    out = written(rows.join(often, "f", "left_semi"))
    drop_written(often)
    return out


def settle(rows: DataFrame, earlier: bool) -> DataFrame:
    """(_k, _x, lo, n, go, covered, open) of the runs that are covered whole or go on to the next pass.

    A run is covered if an equal one begins elsewhere; if earlier, in a document with a smaller id. go: with how
    many starts a row goes on. Of equal runs in one row that is the first one's, as all are covered; if earlier, all.
    """
    place = F.struct("_k", "_x", "lo")
    kinds = written(rows.groupBy("f", "u").agg(F.sum("times").alias("c"), F.min(place).alias("r")))
    mixed = written(kinds.groupBy("f").agg(F.count("*").alias("v")).filter("v > 1").select("f", "v"))
    told = written(kinds.join(mixed, "f", "left").filter("c > 1 or v > 1").select("f", "u", "c", "r", F.col("v").isNotNull().alias("mixed")))
    covered = F.col("_k") > F.col("r._k") if earlier else F.col("c") > 1
    first = F.col("_k") == F.col("r._k") if earlier else (F.col("r") == place)
    go = F.col("n") if earlier else F.expr("cast(n div times as int)")
    out = rows.join(told, ["f", "u"]).select("_k", "_x", "lo", "n", go.alias("go"), covered.alias("covered"), (F.col("mixed") & first).alias("open"))
    out = written(out.filter("covered or open"))
    drop_written(kinds, mixed, told)
    return out


def parts(rows: DataFrame) -> DataFrame:
    """(_k, _x, iv): each document's runs, as start, number, start, ... Rows that agree in both keys hold the same
    runs; these are kept once, so that however many such rows there are, each meets one row's list."""
    return rows.groupBy("_k", "_x").agg(F.flatten(F.collect_set(F.array("lo", "n"))).alias("iv"))


def covered_parts(docs: DataFrame, read: Callable[[pa.RecordBatch], Tokens], depth: int, widths: list[int], earlier: bool, first: DataFrame) -> DataFrame:
    """(_k, _x, _t, iv) for all of docs: iv has the covered window starts. first: the rows of the first pass, written."""
    settled = [settle(first, earlier)]
    drop_written(first)
    for w in widths[1:]:
        there = docs.join(parts(settled[-1].filter("open").select("_k", "_x", "lo", F.col("go").alias("n"))), ["_k", "_x"])
        rows = written(pass_rows(there, read, depth, w))
        settled.append(settle(rows, earlier))
        drop_written(rows)
    every = settled[0].filter("covered")
    for s in settled[1:]:
        every = every.unionByName(s.filter("covered"))
    found = written(parts(every))
    drop_written(*settled)
    return docs.join(found, ["_k", "_x"], "left")


def removed(iv: list[int] | None, depth: int) -> list[tuple[int, int]]:
    """Maximal token spans that the windows starting in iv cover."""
    out: list[list[int]] = []
    for a, n in sorted(zip(iv[::2], iv[1::2], strict=True)) if iv else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + depth)
        else:
            out.append([a, a + n - 1 + depth])
    return [(a, b) for a, b in out]


def kept(whole: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in spans:
        left.append(whole[at:a])
        at = b
    left.append(whole[at:])
    return b"".join(left)
