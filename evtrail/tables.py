"""Intermediate tables in the folder that all executors share, and numbers in an order without a single task for all rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is named: an own one in a single process, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evtrail-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/evtrail-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path of this application in the shared folder, which nothing has been written to."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written and read back: its lineage ends here."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._evtrail_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_evtrail_path", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables this application has written, once its results have been stored elsewhere."""
    _delete(spark, _own_folder(spark))


def numbered(df: DataFrame, column: str, order: list[Column | str], first: int = 1) -> DataFrame:
    """df with a column of numbers from first on, in the given order.

    Rows are dealt out by ranges of the order and sorted there; what a range's numbers begin with is the sum of the
    sizes before it. One number a range is collected, however many rows there are.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    held = written(ranges)
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], first
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    begins = df.sparkSession.createDataFrame(offsets, "_p long, _f long")
    number = F.col("_f") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return held.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(begins), "_p").select(*rest, number.alias(column))


#: Rows of one key from which on its running values are found by several tasks.
HOT = 1_000_000
COMBINE = {"max": F.max, "sum": F.sum}


def any_hot(df: DataFrame, keys: list[str], hot: int = HOT) -> bool:
    """Whether a key has more than hot rows."""
    return bool(df.groupBy(*keys).agg(F.count("*").alias("_c")).filter(F.col("_c") > hot).head(1))


def scanned(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], earlier: bool = False, hot: int = HOT, spread: bool | None = None) -> DataFrame:
    """df with running values for each key in an order: of the rows up to each one, or if earlier of those before it.

    values: {name: ("max" or "sum", column)}; keys and order make rows distinct. Where no key has more than hot
    rows that is one window. Otherwise rows are dealt out by ranges of key and order, so that a key's rows spread over
    as many tasks as they fill; what the ranges before hold of a key is summed up, a row for each key and range, and
    carried into the window of each range. spread: which way to go, if the caller knows.
    """
    end = -1 if earlier else 0
    # Written first, as it is read more than once: to count, and to cut ranges by samples.
    df = df if spread is False else written(df)
    if not (any_hot(df, keys, hot) if spread is None else spread):
        past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: COMBINE[how](c).over(past) for n, (how, c) in values.items()})
    held = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.shiftright(F.monotonically_increasing_id(), 33)))
    # Each range's own value of a key, then that of all ranges before. A sum of sums is a sum, a maximum of maxima one.
    part = held.groupBy(*keys, "_p").agg(*[COMBINE[how](c).alias(n) for n, (how, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_p"))]
    carry = part.select(*named, *[COMBINE[how](n).over(before).alias(f"_{n}") for n, (how, _) in values.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_p"))]
    both = held.join(carry, reduce(Column.__and__, same), "left")
    own = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)

    def total(name: str, how: str, c: str) -> Column:
        here, carried = COMBINE[how](c).over(own), F.col(f"_{name}")
        return F.coalesce(here + carried, here, carried) if how == "sum" else F.greatest(here, carried)

    return both.withColumns({n: total(n, *v) for n, v in values.items()}).drop("_p", *[f"_k{i}" for i in range(len(keys) + 1)], *[f"_{n}" for n in values])
