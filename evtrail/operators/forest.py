"""Forests by Euler tour and list ranking (survey E2-E5): root, depth, preorder and size of every node, in rows that grow with the nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_written, numbered, scanned, written

#: Elements of lists that one task ranks (some 40 MB), and the share of elements that a longer set of lists is contracted to.
HERE, SHARE = 1 << 20, 16
ELEMENT = "e long, back long, first long, s long, d long"


def _here(lists: DataFrame) -> DataFrame:
    """list_ranks() of at most HERE elements, in one task: each round goes twice as far back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches), pa.schema([(x.split()[0], pa.int64()) for x in ELEMENT.split(", ")])).sort_by("e")
        e, first, s, d = (own.column(c).to_numpy().copy() for c in ("e", "first", "s", "d"))
        back = own.column("back").fill_null(-1).to_numpy()
        has = ~own.column("back").is_null().to_numpy(zero_copy_only=False)
        at = np.where(has, np.searchsorted(e, back), -1)
        for _ in range(len(e).bit_length() + 1):
            go = np.flatnonzero(at >= 0)
            if not len(go):
                break
            to = at[go]
            s[go], d[go], first[go], at[go] = s[go] + s[to], d[go] + d[to], first[to], at[to]
        good = at < 0
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (e, first, s, d)], ["e", "first", "s", "d"])

    return lists.coalesce(1).mapInArrow(run, "e long, first long, s long, d long")


def list_ranks(lists: DataFrame, here: int = HERE) -> DataFrame:
    """(e, first, s, d): each element's first one back in its list, and the sums of s and d from there to itself.

    lists: (e, back, s, d), back being the element before or null. Elements on a list that comes back to itself have
    no row. A share of the elements is chosen by hash; all go back to the nearest chosen one by doubling steps, the
    chosen ones are ranked in the same way, and their sums are added. At each step an element is met by one other, so
    no key is hot.
    """
    columns = [x.split()[0] for x in ELEMENT.split(", ")]
    now = written((lists if "first" in lists.columns else lists.withColumn("first", F.col("e"))).select(*columns))
    n = now.count()
    if n <= here:
        return _here(now)
    chosen = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(n)), F.lit(SHARE)) == 0
    now = written(now.withColumn("done", F.col("back").isNull() | chosen("back")))
    far = 1
    while far <= 2 * n and now.filter("NOT done").head(1):
        other = now.select(F.col("e").alias("back"), F.col("back").alias("back2"), F.col("first").alias("first2"), F.col("s").alias("s2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        gone = now.filter("NOT done").join(other, "back").select("e", F.col("back2").alias("back"), F.col("first2").alias("first"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
        last, now = now, written(now.filter("done").unionByName(gone))
        drop_written(last)
        far *= 2
    # What isn't done by now goes round.
    now = now.filter("done")
    ranks = written(list_ranks(now.filter(chosen("e")).select(*columns), here))
    open_ = now.filter(~chosen("e"))
    before = ranks.select(F.col("e").alias("back"), F.col("first").alias("f"), F.col("s").alias("s2"), F.col("d").alias("d2"))
    rest = open_.filter("back IS NOT NULL").join(before, "back").select("e", F.col("f").alias("first"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d"))
    return ranks.unionByName(open_.filter("back IS NULL").select("e", "first", "s", "d")).unionByName(rest)


def forest(nodes: DataFrame, here: int = HERE) -> DataFrame:
    """(id, root, depth, pre, size): pre counts a tree's nodes before this one, size those below it and itself.

    nodes: (id, parent, order), parent being null for a root; children come in order of (order, id). So the nodes below
    one are those of its root with pre < p < pre + size. Nodes whose chain of parents comes back to itself, or leads to
    one that isn't there, have no row. Each node is entered and left once on a tour of its tree; a row of the tour
    knows the one before it, and sums over the tour are depth and preorder.
    """
    own = written(numbered(nodes.select("id", "parent", "order"), "o", ["parent", "order", "id"]))
    brother = own.select((F.col("o") + 1).alias("o"), F.col("parent").alias("p2"), F.col("id").alias("brother"))
    placed = own.join(brother, "o", "left").withColumn("brother", F.when(F.col("p2") == F.col("parent"), F.col("brother")))
    youngest = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.max_by("id", "o").alias("child"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    one = F.lit(1).cast("long")
    tour = placed.select(enter("id").alias("e"), F.coalesce(leave("brother"), enter("parent")).alias("back"), one.alias("s"), one.alias("d")).unionByName(
        own.join(youngest, "id", "left").select(leave("id").alias("e"), F.coalesce(leave("child"), enter("id")).alias("back"), (one * 0).alias("s"), (one * -1).alias("d"))
    )
    there = own.select(enter("id").alias("back"))
    if own.filter("parent IS NOT NULL").join(own.select(F.col("id").alias("parent")), "parent", "left_anti").head(1):
        # A step to a node that isn't there ends nowhere: it is turned on itself, and so has no rank.
        there = there.unionByName(own.select(leave("id").alias("back"))).withColumn("is", F.lit(True))
        tour = tour.join(there, "back", "left").select("e", F.when(F.col("back").isNull() | F.col("is"), F.col("back")).otherwise(F.col("e")).alias("back"), "s", "d")
    ranks = list_ranks(tour, here)
    inside = F.col("e") % 2 == 0
    both = ranks.groupBy(F.shiftright("e", 1).alias("id")).agg(*[F.max(F.when(inside, F.col(c))).alias(c) for c in ("first", "s", "d")], F.max(F.when(~inside, F.col("s"))).alias("end"))
    return both.select("id", F.shiftright("first", 1).alias("root"), (F.col("d") - 1).cast("int").alias("depth"), (F.col("s") - 1).alias("pre"), (F.col("end") - F.col("s") + 1).alias("size"))


def below(trees: DataFrame, heads: DataFrame) -> DataFrame:
    """(id): heads (id) and all nodes below them, in forest() rows. A node is below one if a head entered before it ends after it."""
    marked = trees.join(heads.select("id").distinct().withColumn("is", F.lit(True)), "id", "left")
    ends = marked.withColumn("end", F.when(F.col("is"), F.col("pre") + F.col("size")))
    return scanned(ends, ["root"], ["pre"], {"reach": ("max", "end")}).filter(F.col("reach") > F.col("pre")).select("id")
