"""What the training-data operators share: keyed input, bounded Arrow slices, written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id is carried as this value between stages; it sorts before every other id.
NULL_ID = -(2**63)
#: Text bytes that one numpy step handles; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


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


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._evtrail_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_evtrail_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables this application has written, once its results have been stored elsewhere."""
    _delete(spark, _own_folder(spark))


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts fits a worker; shuffle files go when a query ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(_k, _x, _t): id without nulls, hash of the text, text without nulls.

    _k and _x together stand for a row; rows that agree in both hold the same text, so one answer serves each.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_k"),
        F.xxhash64(text).alias("_x"),
        text.alias("_t"),
    )


def plain_id(name: str = "_k"):
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias("doc_id")


def id_and_text(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.coalesce(docs["text"].cast("string"), F.lit(""))


def bitmap_rows(values: DataFrame, column: str, most: int = 27) -> tuple[int, DataFrame]:
    """(b, rows): which of 2^b bits the column's hashes set, in rows (r, bits) of 4 KB. 16 bits a value, up to 2^most."""
    held = written(values.select(F.col(column).alias("f")))
    b = min(most, max(15, (16 * max(1, held.count())).bit_length()))
    bit = F.col("f").bitwiseAND(F.lit((1 << b) - 1))
    rows = held.select(F.shiftright(bit, 15).alias("r"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("p")).groupBy("r").agg(F.bitmap_construct_agg("p").alias("bits"))
    return b, written(rows)


def bitmap_array(b: int, rows: DataFrame) -> np.ndarray:
    """The bitmap's 2^(b - 3) bytes, at most 16 MB with the default of bitmap_rows."""
    out = np.zeros((1 << (b - 15), 1 << 12), np.uint8)
    for r in rows.collect():
        out[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bitmap(df: DataFrame, column: str, b: int, rows: DataFrame) -> DataFrame:
    """df without rows whose hash in column sets no bit; what is sent has at most 2^(b - 15) rows of 4 KB. Columns r and bits are its own."""
    bit = F.col(column).bitwiseAND(F.lit((1 << b) - 1))
    met = df.withColumn("r", F.shiftright(bit, 15)).join(F.broadcast(rows), "r")
    place = bit.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    byte = F.ascii(F.decode(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1)), "ISO-8859-1"))
    return met.filter(F.getbit(byte.cast("long"), place.bitwiseAND(F.lit(7))) == 1).drop("r", "bits")


def one_row_each(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are in keep (_k, _x, c), with all their columns.

    Where c counts several rows alike in id and text, one stays: the least by all columns, or by their JSON where a
    column (a map, a variant) has no order. keep is a written table.
    """
    names = docs.columns
    id_, text = id_and_text(docs)
    kept = docs.join(keep, (id_ == keep["_k"]) & (F.xxhash64(text) == keep["_x"]), "left_semi")
    if not keep.filter("c > 1").head(1):
        return kept
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    unordered = any(x in docs.schema.simpleString() for x in ("map<", "variant"))
    alike = kept.groupBy(id_.alias("_k"), text.alias("_t")).agg((F.min_by(row, F.to_json(row)) if unordered else F.min(row)).alias("r"))
    return alike.select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text in column passes limit bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes, b"" for null."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def joined(batch: pa.RecordBatch, column: str) -> tuple[bytes, np.ndarray]:
    """All bytes of the column in one piece, and where each row begins, with the end of the last."""
    parts = raw(batch, column)
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return b"".join(parts), ends


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
