"""Operator 5: passages of words that an earlier document holds, with a count-min prefilter.

A first pass over the documents counts the keys of their windows' runs (windows.py) in a count-min sketch: each task
makes a sketch of its own, sketches are merged block by block, and what is left of the merged one is a bit for each
cell that two or more keys fell into. As a cell never counts less than its keys, a key whose cells are not all set
occurs once. The second pass drops just those runs and groups the others exactly; no repeated window is lost.
The sketch is sized by the text up to MOST_CELLS, so the broadcast bits have a fixed bound; past that size it only
lets more through.

Null texts have no words; documents of fewer words than a window lose nothing. Rows with one doc_id don't count as
earlier than each other, whatever they hold. A null doc_id counts as smaller than every other and is returned as
null. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import keyed, plain_id, raw, slices, written

DEPTH, WIDTHS = 50, [32, 1]
#: Sketch rows, bits of a cell's place in its block, and bounds of the cells in a sketch row.
ROWS, BLOCK_BITS, LEAST_CELLS, MOST_CELLS = 3, 16, 1 << 16, 1 << 27
#: Partial sketches of a block that one task merges.
FAN_IN = 64
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def cells(f: np.ndarray, row: int, n: int) -> np.ndarray:
    mixed = (f ^ (f >> np.uint64(31))) * np.uint64(SALTS[row])
    return (mixed >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _emit(held: list[np.ndarray], n: int, part: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch: for each block its touched cells, those touched more than once twice."""
    f = np.concatenate(held)
    block, body = [], []
    for row in range(ROWS):
        at, count = np.unique(cells(f, row, n), return_counts=True)
        at = np.repeat(at, np.minimum(count, 2))
        cut = np.flatnonzero(np.diff(at >> BLOCK_BITS)) + 1
        for own in np.split(at, cut):
            block.append(row * (n >> BLOCK_BITS) + int(own[0] >> BLOCK_BITS))
            body.append((own & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([part] * len(block), pa.int32()), pa.array(body, pa.binary())], ["block", "part", "cells"])


def sketch(docs: DataFrame, n: int) -> list[bytes]:
    """The bits of the merged sketch, by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            held.append(b.column("f").to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= 1 << 20:
                yield from _emit(held, n, part)
                held, size = [], 0
        if held:
            yield from _emit(held, n, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = []
            for own in b.column("cells").to_pylist():
                total = np.zeros(1 << BLOCK_BITS, np.uint8)
                for x in own:
                    at, c = np.unique(np.frombuffer(x, np.uint16), return_counts=True)
                    total[at] = np.minimum(total[at] + c, 2)
                at = np.flatnonzero(total)
                body.append(np.repeat(at, total[at]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), pa.array(body, pa.binary())], ["block", "part", "cells"])

    first = windows.pass_rows(docs, windows.word_tokens, DEPTH, WIDTHS[0]).select("f")
    partial = written(first.mapInArrow(count, "block int, part int, cells binary"))
    at_once = partial.groupBy("block").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    groups = at_once
    while groups > 1:
        groups = -(-groups // FAN_IN)
        dealt = F.pmod(F.xxhash64("part", F.length("cells"), F.crc32("cells")), F.lit(groups)).cast("int")
        partial = written(partial.withColumn("part", dealt).groupBy("block", "part").agg(F.collect_list("cells").alias("cells")).mapInArrow(merge, "block int, part int, cells binary"))
    blocks = [bytes((1 << BLOCK_BITS) // 8)] * (ROWS * (n >> BLOCK_BITS))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("cells").to_pylist():
                at, c = np.unique(np.frombuffer(x, np.uint16), return_counts=True)
                flag = np.zeros(1 << BLOCK_BITS, np.uint8)
                flag[at[c > 1]] = 1
                out.append(np.packbits(flag, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    for r in partial.select("block", "cells").mapInArrow(bits, "block int, bits binary").toLocalIterator():
        blocks[r["block"]] = bytes(r["bits"])
    return blocks


def covered(docs: DataFrame) -> DataFrame:
    """(_k, _x, _t, iv) for each row: iv has the starts of windows that an earlier document holds."""
    own = keyed(docs)
    size = own.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(size // 48).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(b"".join(sketch(own, n)))

    def estimated() -> Callable[[np.ndarray], np.ndarray]:
        flags = np.frombuffer(sent.value, np.uint8)

        def keep(f: np.ndarray) -> np.ndarray:
            out = np.ones(len(f), bool)
            for row in range(ROWS):
                at = cells(f, row, n) + row * n
                out &= (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            return out

        return keep

    first = written(windows.pass_rows(own, windows.word_tokens, DEPTH, WIDTHS[0], estimated))
    return windows.covered_parts(own, windows.word_tokens, DEPTH, WIDTHS, True, first)


def _left(text: bytes, iv: list[int] | None) -> tuple[int, int, bytes]:
    words = text.split()
    spans = windows.removed(iv, DEPTH)
    at, out = 0, []
    for a, b in spans:
        out += words[at:a]
        at = b
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            n, gone, left = zip(*[_left(t, iv) for t, iv in zip(raw(b, "_t"), b.column("iv").to_pylist(), strict=True)], strict=True)
            digest = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["_k", "n_words", "n_removed", "kept_sha256"])

    out = covered(docs).mapInArrow(run, "_k long, n_words long, n_removed long, kept_sha256 string")
    return out.select(plain_id(), "n_words", "n_removed", "kept_sha256")


def without_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words that are left, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            left = [_left(t, iv)[2].decode() for t, iv in zip(raw(b, "_t"), b.column("iv").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(left, pa.string())], ["_k", "text"])

    return covered(docs).mapInArrow(run, "_k long, text string").select(plain_id(), "text")
