"""Operator 2: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared once each, whatever number of documents share them. Two that differ in at most r bits
differ by at most r, summed over the four 16-bit lanes, in their population counts; so fingerprints are laid out in
tiles by those four counts, and only tile pairs within that radius are compared, by exclusive-or and bit counts over
whole tiles. A large tile is cut into chunks, and each pair of chunks is a unit of work of its own. A unit returns
links that join what it found (a forest), not all pairs. Components come from repeated joins over written tables.

Null and empty texts have fingerprint zero, linked like any other. Fewer words than a shingle make one shingle.
Repeated rows share a fingerprint and a component. A null doc_id is smaller than any other and is returned as null.
An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop_written, keyed, one_row_each, plain_id, raw, slices, written

#: Fingerprints in a chunk of a tile, and chunks of a tile that meet another tile's chunks under one join key.
CHUNK, TOGETHER = 4096, 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64."""
    own = text.lower().split()
    if not own:
        return 0
    whole = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(own))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(own) - k + 1
    for at in range(0, n, 8192):
        stop = min(n, at + 8192)
        h = np.array([digest(whole[a:b], seed) for a, b in zip(starts[at:stop].tolist(), ends[at + k - 1 : stop + k - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_k, _x, fp) for each row; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            fp = np.array([fingerprint(t) for t in raw(b, "_t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_x"), pa.array(fp)], ["_k", "_x", "fp"])

    return keyed(docs).mapInArrow(run, "_k long, _x long, fp long")


def _lanes(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def _offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """Lane differences within radius, each direction once."""
    span = range(-radius, radius + 1)
    every = [(a, b, c, d) for a in span for b in span for c in span for d in span if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return [o for o in every if o >= (0, 0, 0, 0)]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a and b that differ in at most radius bits as pairs of a and b do."""
    names = np.concatenate([a, b])
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, ua, ub = [], a.view(np.uint64), b.view(np.uint64)
    for at in range(0, len(ua), 256):
        near = np.bitwise_count(ua[at : at + 256, None] ^ ub[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = top(at + i), top(len(a) + j)
            if x != y and names[at + i] != names[len(a) + j]:
                root[y] = x
                out.append((int(names[at + i]), int(names[len(a) + j])))
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect what fingerprints within radius connect. distinct: (fp), each once."""
    lanes = _lanes("fp")
    tile = sum((lane * 17**i for i, lane in enumerate(lanes[1:], 1)), lanes[0])
    tiled = distinct.select("fp", tile.cast("int").alias("tile"))
    # At most 17 ** 4 tiles, so their sizes have a fixed bound.
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = tiled.join(F.broadcast(sizes), "tile").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks").cast("long")).cast("int"))
    packed = written(cut.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps")))
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(o, "abcd", strict=True)]) for o in _offsets(radius)])).alias("o")
    left = packed.select("tile", "chunk", "fps", steps)
    digits = [F.floor(F.col("tile") / 17**i).cast("int") % 17 + F.col("o")[n] for i, n in enumerate("abcd")]
    fits = [(d >= 0) & (d <= 16) for d in digits]
    other = sum((d * 17**i for i, d in enumerate(digits[1:], 1)), digits[0])
    left = left.filter(fits[0] & fits[1] & fits[2] & fits[3]).select(F.col("tile").alias("t"), F.col("chunk").alias("c"), F.col("fps").alias("x"), other.alias("tile"))
    # A full tile's chunks are dealt out by groups: no key holds all pairs of two tiles.
    group = F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / TOGETHER).cast("int"))).alias("g")
    left = left.join(F.broadcast(sizes), "tile").select("t", "c", "x", "tile", group)
    right = packed.select("tile", F.col("chunk").alias("c2"), F.col("fps").alias("y"), F.floor(F.col("chunk") / TOGETHER).cast("int").alias("g"))
    pairs = left.join(right, ["tile", "g"]).filter((F.col("t") != F.col("tile")) | (F.col("c") <= F.col("c2"))).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in ("x", "y"))
                found += _forest(x, y, radius)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches.

    Each round joins every node's larger neighbours to its least one, then all its smaller ones to the least, until
    nothing changes. A node with many neighbours is no trouble: rounds hold sums and joins by node, never lists.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(small, "a")
        after = near.select(F.col("a"), F.col("m").alias("b")).unionByName(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        following = written(after)
        state = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_written(now)
        now = following
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(_k, _x, fp, root, component) for each row, in no join with its text; root is the least fingerprint of those linked, component their least _k."""
    rows = written(fingerprints(docs))
    distinct = written(rows.groupBy("fp").agg(F.min("_k").alias("first")))
    roots = components(links(distinct.select("fp"), radius))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # The least id of a group of fingerprints: groups that were never linked need no second look.
    groups = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = written(joined.join(groups, "root").select("fp", "root", "component"))
    return rows.join(named, "fp").select("_k", "_x", "fp", "root", "component")


def report(docs: DataFrame) -> DataFrame:
    rows = near_duplicates(docs)
    return rows.select(plain_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of linked fingerprints, with all its columns: that of the least id.

    Of several rows with that id in a group the text with the least hash stays, and of rows alike in both the least by
    all columns, or by their JSON where a column has no order. Groups that share an id, or have none, keep a row each.
    An empty table gives no rows. Two columns of one name are refused by Spark, as docs["text"] is ambiguous then.
    """
    rows = near_duplicates(docs).filter("_k = component")
    keep = written(rows.groupBy("root").agg(F.min("_k").alias("_k"), F.min("_x").alias("_x"), F.count("*").alias("c")))
    return one_row_each(docs, keep)
