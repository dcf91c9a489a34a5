"""Operator 13: exact dedup by a 128-bit content hash, with the bytes compared inside groups.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Three passes, all native columns:
1. Each row becomes a narrow one (id, length, MD5 of the normalised text), written once; groups are counted by hash.
2. Texts whose hash is repeated are grouped by hash and bytes, so that texts of one hash that differ come apart. A
   bitmap of the repeated hashes (16 MB at any size) keeps the other texts out of this shuffle.
3. Narrow rows meet their group. Groups that hold over a 4,096th of all rows are at most 4,096 and are broadcast; no
   key of the rest is large.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id, then
with the least text hash, then the one that was read first. Null and empty texts are equal to each other and to texts
of white space alone. A null doc_id is smaller than any other and is returned as null. An empty table gives no rows.
Other columns, whatever their names, aren't read by report().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_rows, in_bitmap, keyed, one_row_each, plain_id, written

#: A group over a 4,096th of all rows is large: there are at most 4,096 such groups.
SHARE = 4096


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _several(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(h): hashes that texts of different bytes share."""
    repeated = rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select(F.xxhash64("h").alias("f"))
    met = in_bitmap(texts.withColumn("f", F.xxhash64("h")), "f", *bitmap_rows(repeated, "f"))
    different = met.groupBy("h", "s").agg(F.count("*").alias("c"))
    return written(different.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))


def members(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(_k, _x, sha, keep, size, kept) for each row: the id that stays, the group's size, and whether this row is the one.

    digest: a text's content hash; whatever it is, texts are told apart by their bytes.
    """
    texts = keyed(docs).select("_k", "_x", F.length("_t").cast("long").alias("n"), normalised(F.col("_t")).alias("s"))
    texts = texts.withColumn("h", digest(F.col("s")))
    rows = written(texts.select("_k", "_x", "n", "h", F.unhex(F.sha2(F.col("s").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("u")))
    several = _several(texts.select("h", "s"), rows)
    if several.head(1):
        # Rows of a hash that has several texts are told apart by the text itself, and so are read with it.
        told = texts.join(several, "h", "left_semi").select("_k", "_x", "h", F.col("s").alias("v")).distinct()
        rows = written(rows.join(told, ["_k", "_x", "h"], "left").withColumn("v", F.coalesce("v", F.lit(""))))
    else:
        rows = rows.withColumn("v", F.lit(""))
    order = F.struct((-F.col("n")).alias("n"), "_k", "_x", "u")
    groups = written(rows.groupBy("h", "v").agg(F.count("*").alias("size"), F.min(order).alias("best")).filter("size > 1"))
    least = rows.count() // SHARE
    large, rest = groups.filter(F.col("size") > least), groups.filter(F.col("size") <= least)
    out = rows.join(F.broadcast(large), ["h", "v"]).unionByName(rows.join(F.broadcast(large.select("h", "v")), ["h", "v"], "left_anti").join(rest, ["h", "v"], "left"), allowMissingColumns=True)
    alone = F.col("size").isNull()
    return out.select(
        "_k",
        "_x",
        "sha",
        F.when(alone, F.col("_k")).otherwise(F.col("best._k")).alias("keep"),
        F.coalesce("size", F.lit(1)).alias("size"),
        (alone | (F.col("best.u") == F.col("u"))).alias("kept"),
    )


def report(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    rows = members(docs, digest)
    return rows.select(plain_id(), plain_id("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, with all its columns.

    Of rows alike in id and text the least by all columns stays. Column names may be any; an empty table gives no rows.
    """
    rows = members(docs).groupBy("_k", "_x").agg(F.max("kept").alias("kept"), F.count("*").alias("c"))
    return one_row_each(docs, written(rows.filter("kept").select("_k", "_x", "c")))
