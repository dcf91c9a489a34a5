"""Operator 1: exact repeats of bytes, by a depth-limited radix sort of suffixes.

Suffixes are told apart through the threshold only, most significant digit first (windows.py): a pass splits the
groups that are left by a longer stretch of each suffix, suffixes that are alone in their group drop out, and groups
that are still together at full depth are just the repeated windows. A digit is a stretch of many bytes and is
compared by its hash; of successive suffixes only those at anchors, the places of least hash in a stretch, have a row
of their own, the others follow from them. Order between groups isn't needed and not kept.

Null counts as empty; texts shorter than the threshold lose nothing. Repeated rows are repeats of each other. A null
doc_id is returned as null. Ties don't arise: what is removed doesn't depend on any order. An empty table gives no
rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows
from .common import drop_written, keyed, plain_id, raw, slices, written


def widths(depth: int) -> list[int]:
    """Coarse to fine; the coarse digit still has over a third of the threshold."""
    return [max(1, depth * 5 // 8), max(1, depth // 12), 1]


def covered(docs: DataFrame, depth: int = 400) -> DataFrame:
    """(_k, _x, _t, iv) for each row: iv has the starts of repeated windows."""
    own = keyed(docs)
    w = widths(depth)
    rows = written(windows.pass_rows(own, windows.byte_tokens, depth, w[0]))
    first = windows.repeated_f(rows)
    drop_written(rows)
    return windows.covered_parts(own, windows.byte_tokens, depth, w, False, first)


def report(docs: DataFrame, depth: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            size, gone, number, digest = [], [], [], []
            for text, iv in zip(raw(b, "_t"), b.column("iv").to_pylist(), strict=True):
                spans = windows.removed(iv, depth)
                size.append(len(text))
                gone.append(sum(e - a for a, e in spans))
                number.append(len(spans))
                digest.append(hashlib.sha256(windows.kept(text, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())], ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = covered(docs, depth).mapInArrow(run, "_k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(plain_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, depth: int = 400) -> DataFrame:
    """(doc_id, text): the bytes that are left; where a cut splits a character, its rest becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            left = [windows.kept(t, windows.removed(iv, depth)).decode("utf-8", "replace") for t, iv in zip(raw(b, "_t"), b.column("iv").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(left, pa.string())], ["_k", "text"])

    return covered(docs, depth).mapInArrow(run, "_k long, text string").select(plain_id(), "text")
