"""Operator 10: exact top-k inner products over norm-sorted vectors.

The candidates are written once, range-partitioned and sorted by descending length. The longest of them, SEED at most,
give each query a k-th score to beat before the pass; by Cauchy-Schwarz a candidate shorter than the least such score
over the query's length can't be among its best, and the filter on the length skips its files and row groups.

Queries come in blocks of bounded size, PASS_BYTES of them broadcast to one pass. A task takes its candidates in
chunks, longest first, in a basis turned by the SVD of a query block: the leading part of a product plus the
Cauchy-Schwarz bound of the rest rules most pairs out, and only pairs whose bound reaches the query's k-th score are
computed whole. Once the lengths alone can't reach any query's k-th score, the chunk is done.

Vectors that are null, empty, or hold components that are null or not finite (before or after scaling) take no part,
nor do rows without an id. Candidates with another number of components than the query take no part in its result.
Each of several rows with one id is a candidate; rows with the query's own id are none of its candidates. An empty
table gives no rows; other columns aren't read. Scores are exact; one that doesn't fit in a long becomes the nearest
long, and such scores tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes and rows of a query block, bytes of queries in one pass, candidates taken together, and those compared in one step.
QUERY_BYTES, QUERY_ROWS, PASS_BYTES, CHUNK, STEP, LEAD = 4 << 20, 2048, 32 << 20, 8192, 512, 16
#: The longest candidates that give queries a first k-th score: rows and bytes, at most.
SEED, SEED_BYTES = 4096, 4 << 20
LEAST, MOST, NONE = -(2**63), 2**63 - 1, np.iinfo(np.int64).max


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) for each usable vector."""
    scaled = F.transform(table["embedding"], lambda x: x.cast("double") * scale)
    # From 2 ** 53 on a double is whole; floor() would end at the largest long.
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < 2**53, F.floor(y).cast("double")).otherwise(y))
    bad = F.exists(scaled, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    ok = table["vec_id"].isNotNull() & table["embedding"].isNotNull() & (F.size(table["embedding"]) > 0) & ~F.coalesce(bad, F.lit(False))
    return table.filter(ok).select(table["vec_id"].cast("long").alias("vec_id"), whole.alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by score, then by smaller id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Rows whose products with each other are exact in doubles."""
    return np.abs(vectors).max(axis=1, initial=0) < np.sqrt(2.0**52 / max(1, vectors.shape[1]))


def _floor(queries: tuple[np.ndarray, np.ndarray], seed: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query a score that k candidates reach; minus infinity where none is known."""
    ids, vectors = queries
    out = np.full(len(ids), -np.inf)
    if seed is None:
        return out
    some, plain = _exact(seed[1]), _exact(vectors)
    if some.sum() >= k and plain.any():
        score = np.where(ids[plain, None] == seed[0][None, some], -np.inf, vectors[plain] @ seed[1][some].T)
        out[plain] = np.partition(score, some.sum() - k, axis=1)[:, some.sum() - k]
    return out


def _least_length(vectors: np.ndarray, floor: np.ndarray) -> float:
    """No shorter candidate is among the best of any of these queries."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        need = np.where(floor > 0, floor / np.linalg.norm(vectors, axis=1), 0.0)
    return float(need.min(initial=0.0 if not len(need) else np.inf)) * (1 - 1e-9)


class Block:
    """Queries of one dimension with their best candidates so far; floor: a score that k candidates reach, for each."""

    def __init__(self, first: int, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.k, plain, number = k, _exact(vectors), np.arange(first, first + len(ids))
        self.every = (number, ids, vectors)
        self.huge = tuple(x[~plain] for x in self.every)
        self.number, self.ids, self.q = (x[plain] for x in self.every)
        self.floor = floor[plain]
        self.scores = np.full((len(self.ids), k), -np.inf)
        self.found = np.full((len(self.ids), k), NONE)
        self.others: dict[int, list[tuple[int, int]]] = {}
        self.turn = np.linalg.svd(self.q, full_matrices=True)[2].T if len(self.q) else np.eye(vectors.shape[1])
        self.rotated = self.q @ self.turn
        self.lead = min(LEAD, vectors.shape[1])
        self.rest = np.linalg.norm(self.rotated[:, self.lead :], axis=1)
        self.norm = np.linalg.norm(self.q, axis=1)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        plain = _exact(vectors)
        if not plain.all():
            self._wide(*self.every, ids[~plain], vectors[~plain])
            ids, vectors = ids[plain], vectors[plain]
        if len(self.huge[0]):
            self._wide(*self.huge, ids, vectors)
        norm = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norm, kind="stable")
        ids, vectors, norm = ids[order], vectors[order], norm[order]
        rotated = vectors @ self.turn
        rest = np.linalg.norm(rotated[:, self.lead :], axis=1)
        for at in range(0, len(ids), STEP):
            part = slice(at, at + STEP)
            least = np.maximum(self.scores[:, -1], self.floor)
            reach = self.norm * norm[at] * (1 + 1e-9) + 1e-6
            live = np.flatnonzero(reach >= least)
            if not len(live):
                return
            bound = self.rotated[live, : self.lead] @ rotated[part, : self.lead].T + np.outer(self.rest[live], rest[part])
            may = bound * (1 + np.copysign(1e-9, bound)) + 1e-6 >= least[live, None]
            may &= self.ids[live, None] != ids[None, part]
            some = may.any(axis=1)
            live, may = live[some], may[some]
            if not len(live):
                continue
            cols = np.flatnonzero(may.any(axis=0))
            scores = np.where(may[:, cols], self.q[live] @ vectors[part][cols].T, -np.inf)
            self._keep(live, scores, np.broadcast_to(ids[part][cols], scores.shape))

    def _keep(self, live: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        ids = np.where(np.isneginf(scores), NONE, ids)
        self.scores[live], self.found[live] = _best(np.hstack([self.scores[live], scores]), np.hstack([self.found[live], ids]), self.k)

    def _wide(self, numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Products that doubles can't hold, by whole numbers of any size; of each query the k best are kept."""
        whole = [list(map(int, v)) for v in vectors.tolist()]
        for n, i, q in zip(numbers.tolist(), query_ids.tolist(), queries.tolist(), strict=True):
            own = list(map(int, q))
            both = self.others.get(n, []) + [(-min(MOST, max(LEAST, sum(map(int.__mul__, own, c)))), j) for c, j in zip(whole, ids.tolist(), strict=True) if j != i]
            self.others[n] = sorted(both)[: self.k]

    def rows(self) -> pa.RecordBatch:
        at, rank = np.nonzero(self.found != NONE)
        number, query, found, score = self.number[at].tolist(), self.ids[at].tolist(), self.found[at, rank].tolist(), self.scores[at, rank].astype(np.int64).tolist()
        first = int(self.every[0][0])
        for n, best in self.others.items():
            for s, j in best:
                number.append(n)
                query.append(int(self.every[1][n - first]))
                found.append(j)
                score.append(-s)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (number, query, found, score)], ["q", "query_id", "vec_id", "score"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) in chunks, one number of components each."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        ids = b.column("vec_id").to_numpy(zero_copy_only=False)
        v = b.column("v")
        size = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            own = flat[(ends[rows] - d)[:, None] + np.arange(d)]
            kept.setdefault(int(d), []).append((ids[rows], own))
            if sum(len(x) for x, _ in kept[int(d)]) >= CHUNK:
                yield tuple(map(np.concatenate, zip(*kept.pop(int(d)), strict=True)))
    for parts in kept.values():
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _as_arrays(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by their number of components."""
    out: dict[int, tuple[list[int], list[list[float]]]] = {}
    for r in rows:
        ids, vectors = out.setdefault(len(r["v"]), ([], []))
        ids.append(r["vec_id"])
        vectors.append(r["v"])
    return {d: (np.array(i, np.int64), np.array(v, np.float64)) for d, (i, v) in out.items()}


def _passes(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The query blocks of each pass."""
    rows = queries.toLocalIterator()
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: dict[int, list] = {}
    size = 0
    while part := list(islice(rows, 256)):
        for r in part:
            own = waiting.setdefault(d := len(r["v"]), [])
            own.append(r)
            if len(own) >= max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * d))):
                ready.append(_as_arrays(waiting.pop(d))[d])
                size += 8 * d * len(own)
            if size >= PASS_BYTES:
                yield ready
                ready, size = [], 0
    ready += [_as_arrays(own)[d] for d, own in waiting.items()]
    if ready:
        yield ready


def _pass(candidates: DataFrame, blocks: list[tuple[np.ndarray, np.ndarray]], seed: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The best of these queries, over all candidates that are long enough for one of them."""
    floors = [_floor(b, seed.get(b[1].shape[1]), k) for b in blocks]
    least = min(_least_length(b[1], f) for b, f in zip(blocks, floors, strict=True))
    sent = candidates.sparkSession.sparkContext.broadcast([(*b, f) for b, f in zip(blocks, floors, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.cumsum([0, *[len(b[0]) for b in sent.value]]).tolist()
        made = [Block(first, *b, k) for first, b in zip(firsts, sent.value, strict=False)]
        for own, rows in _matrices(batches):
            for block in made:
                if rows.shape[1] == block.turn.shape[0]:
                    block.add(own, rows)
        yield from (block.rows() for block in made)

    best = candidates.filter(F.col("length") >= least).select("vec_id", "v").mapInArrow(run, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def by_length(candidates: DataFrame) -> DataFrame:
    """(vec_id, v, length), written by descending length. Equal lengths are dealt out by a hash, so that no file holds them all.

    The length is an upper bound, by a share that is more than what the order of a sum can change.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) * (1 + 1e-9)
    salted = candidates.select("vec_id", "v", length.alias("length"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("s"))
    return written(salted.repartitionByRange(F.desc("length"), "s").sortWithinPartitions(F.desc("length")).drop("s"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): both sides as integer_vectors() gives them. Each row of queries gets its own result."""
    spark, none = candidates.sparkSession, "query_id long, rank int, vec_id long, score long"
    ordered = by_length(candidates)
    wide = ordered.agg(F.max(F.size("v"))).first()[0]
    if wide is None:
        return spark.createDataFrame([], none)
    seed = _as_arrays(ordered.orderBy(F.desc("length")).limit(max(1, min(SEED, SEED_BYTES // (8 * wide)))).collect())
    out: list[DataFrame] = []
    for blocks in _passes(queries):
        out.append(_pass(ordered, blocks, seed, k))
        if len(out) > 1:  # a single pass stays lazy; more are written one by one
            out[:] = [x if hasattr(x, "_evtrail_path") else written(x) for x in out]
    if not out:
        return spark.createDataFrame([], none)
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every
