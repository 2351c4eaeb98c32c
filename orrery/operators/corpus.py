"""A corpus of texts with their vectors: embedded by a given function, written beside the table, verified, and only then in its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import versions

#: Texts that are given to the embedder at a time.
BATCH = 64


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], width: int, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """rows with ``out``, an array of ``width`` floats; ``embed`` takes a list of texts and gives a matrix with a row for each.

    Null texts are empty. A matrix of another shape, or with a value that isn't finite, is an error.
    """
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(out, T.ArrayType(T.FloatType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BATCH):
                b = whole.slice(s, BATCH)
                texts = [t or "" for t in b.column(text_col).to_pylist()]
                vectors = np.asarray(embed(texts), np.float32)
                if vectors.shape != (len(texts), width) or not np.isfinite(vectors).all():
                    raise ValueError(f"the embedder gave {vectors.shape} for {len(texts)} texts, or values that aren't finite")
                flat = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), width).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, out])

    return rows.select(*kept).mapInArrow(run, schema)


def summary(rows: DataFrame, columns: list[str], out: str = "embedding") -> dict:
    """Rows, least and most width of the vectors, and a sum of the rows' hashes, which is the same in any order."""
    size = F.size(out)
    got = rows.agg(
        F.count("*").alias("rows"), F.min(size).alias("least"), F.max(size).alias("most"),
        F.sum(F.xxhash64(*columns, out).cast("decimal(20,0)")).alias("hash"),
    ).first()
    return {"rows": got["rows"], "least": got["least"], "most": got["most"], "hash": got["hash"]}


class Unverified(ValueError):
    """What was read back isn't what was written."""


def build(rows: DataFrame, embed, width: int, path: str, columns: list[str], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Write ``columns`` of rows and their vectors as the table at ``path`` (see ``versions``), and read it.

    The rows are counted and hashed while they are written. The table is read back before it counts: other counts, widths or
    sums of hashes leave the table that was there, as does any failure before.
    """
    from pyspark.sql import Observation

    made = embedded(rows.select(*columns, *([] if text_col in columns else [text_col])), embed, width, text_col, out).select(*columns, out)
    seen = Observation()
    watched = made.observe(
        seen, F.count("*").alias("rows"), F.sum(F.xxhash64(*columns, out).cast("decimal(20,0)")).alias("hash")
    )

    def check(back: DataFrame) -> None:
        got, want = summary(back, columns, out), seen.get
        widths = (width, width) if want["rows"] else (None, None)
        if (got["rows"], got["hash"], got["least"], got["most"]) != (want["rows"], want["hash"], *widths):
            raise Unverified(f"{path}: wrote {want}, read {got}")

    versions.replace(watched, path, "parquet", check)
    return versions.read(rows.sparkSession, path, made.schema)
