"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the contracts, as the characters themselves.
SPACES = " \t\n\x0b\x0c\r"
#: Translation that lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of intermediate tables: spark.checkpoint.dir, or a temporary one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="orrery-")
            spark.sparkContext.setCheckpointDir(base)
    if base not in _roots:
        _roots[base] = f"{base.rstrip('/')}/orrery-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, _roots[base])
    return _roots[base]


def _forget(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of very many rows up to which their table is broadcast, at some 50 bytes each.
BROADCAST_HOT = 500_000


def left_join_split(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], hot: int) -> DataFrame:
    """left with the columns of right, nulls where it has no row; right has a row for each key, and null keys are equal.

    ``keys`` are pairs of a column of left and one of right. The rows of a key that has more than ``hot`` of them in left
    are dealt out by a hash of the whole row, and its row of right is copied for each part, so that no task gets them all.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    counts = left.groupBy(*[F.col(f"`{a}`").alias(k) for k, (a, _) in zip(names, keys, strict=True)]).agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") > hot).select(*names, F.ceil(F.col("n") / hot).cast("int").alias("__copies"))
    often = materialize(often, "hot")
    few = often.count() <= BROADCAST_HOT
    copies = F.coalesce(F.col("__copies"), F.lit(1))

    def marked(df: DataFrame, columns: list[str]) -> DataFrame:
        on = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(columns, names, strict=True)]
        return df.join(F.broadcast(often) if few else often, reduce(and_, on), "left")

    # Maps and variants have no hash.
    hashable = [f.name for f in left.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), copies)
    own = marked(left, [a for a, _ in keys]).withColumn("__copy", dealt.cast("int")).drop("__copies", *names)
    each = marked(right, [b for _, b in keys]).withColumn("__at", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies", *names)
    on = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in keys]
    return own.join(each, reduce(and_, on) & (F.col("__copy") == F.col("__at")), "left").drop("__copy", "__at")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within it, actions hand Python workers Arrow batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], col: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``size`` bytes of a text or binary column; no run is empty."""
    for b in batches:
        at = b.schema.get_field_index(col)
        sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), b.num_rows]
        yield from (b.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False) if e > s)


def appended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    """df without columns named like the new fields (any case), and its schema with those fields at the end."""
    names = {n.lower() for n, _ in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.schema.fields])
    for n, kind in fields:
        schema = schema.add(n, kind, True)
    return kept, schema


def words_of(text: Column) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+` of a text, from byte-wise replacement and a one-character split."""
    for c in SPACES.replace(" ", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
