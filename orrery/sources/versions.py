"""Tables that are replaced whole: each state is a folder of its own, and an empty file whose name is made at once says which counts.

    path/<format>-<unique>/               the rows of a state
    path/_commits/<number>.<folder>       one for each state; the highest number is the table

A reader lists the commits and reads the folder of the last one. A writer that fails before it commits leaves the table as it was;
a folder without a commit is never read. The state before the last stays, for readers that have just begun; older ones go.
One writer at a time is meant: of two that commit at once one wins, and both folders are whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMITS = "_commits"
#: States that stay.
KEPT = 2


def _files(spark: SparkSession, path: str):
    """(file system, a function that makes paths)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at(path))


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the table's states, the last one last."""
    fs, at = _files(spark, path)
    where = at(f"{path}/{COMMITS}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((int(n), f) for n, _, f in (name.partition(".") for name in names if name[:1].isdigit()))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the table as it stands; None if there is none."""
    found = commits(spark, path)
    return f"{path}/{found[-1][1]}" if found else None


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table's rows as they stand; no rows where there is no table."""
    where = current(spark, path)
    if where is None:
        return spark.createDataFrame([], schema)
    kind = where.rsplit("/", 1)[1].partition("-")[0]
    return spark.read.schema(schema).format(kind).load(where)


def replace(df: DataFrame, path: str, kind: str = "parquet", check: Callable[[DataFrame], None] | None = None) -> None:
    """Make df the table. ``check`` gets the rows as they are read back, and raises to leave the table as it was."""
    spark = df.sparkSession
    folder = f"{kind}-{uuid.uuid4().hex}"
    fs, at = _files(spark, path)
    try:
        df.write.format(kind).save(f"{path}/{folder}")
        if check:
            check(spark.read.schema(df.schema).format(kind).load(f"{path}/{folder}"))
    except BaseException:
        fs.delete(at(f"{path}/{folder}"), True)
        raise
    states = commits(spark, path)
    number = states[-1][0] + 1 if states else 1
    if not fs.createNewFile(at(f"{path}/{COMMITS}/{number:012d}.{folder}")):
        raise OSError(f"{path}: state {number} is there already")
    for old, name in states[: len(states) + 1 - KEPT]:
        # The commit goes first: what has one is whole.
        fs.delete(at(f"{path}/{COMMITS}/{old:012d}.{name}"), False)
        fs.delete(at(f"{path}/{name}"), True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one of a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
