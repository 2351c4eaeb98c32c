"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` adds the ids of each text as little-endian unsigned 32-bit integers and their number; ``decode`` turns such
a column back into the raw bytes. Both run as Arrow maps: no shuffle, one batch of bounded bytes in a worker at a time.

Null texts count as empty and give an empty id string. Columns of the input that are named like a result are replaced.
A text of any length is cut at safe boundaries first, so that the regular expression and the merges see a bounded
piece, unless a single match of the pattern is longer.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended, slices

#: Texts of more characters than this are cut at safe boundaries.
PIECE_CHARS = 1 << 16
#: Bytes of a batch that a worker holds as Python objects at once.
SLICE_BYTES = 4 << 20
#: Where no match of the pattern can reach across: a run of spaces begins after a non-space, or a run of letters or
#: digits ends. Matches begin with at most one space, so what stands on either side is split as in the whole text.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W\d_])(?=[\W\d_])|(?<=[0-9])(?=[^0-9\w])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, built once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut only where every match of the pattern ends anyway."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        at = cut.start() if cut else len(text)
        yield text[start:at]
        start = at
    if start < len(text) or not text:
        yield text[start:]


def encode_text(enc, text: str, limit: int = PIECE_CHARS) -> np.ndarray:
    if len(text) <= limit:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in safe_pieces(text, limit)])


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens",
    keep_text: bool = True,
) -> DataFrame:
    """df with ``ids_col`` binary (ids as little-endian unsigned 32-bit integers) and ``count_col`` long.

    Without keep_text the text stays in the worker, which halves what it sends back.
    """
    kept, schema = appended(df, [(ids_col, T.BinaryType()), (count_col, T.LongType())])
    source = df.select(*kept.columns) if text_col in kept.columns else df
    gone = [ids_col, count_col] if keep_text else [ids_col, count_col, text_col]
    names = [n for n in schema.fieldNames() if n not in gone]
    schema = T.StructType([f for f in schema.fields if f.name in [*names, ids_col, count_col]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, text_col, SLICE_BYTES):
            ids = [encode_text(enc, t or "") for t in b.column(text_col).to_pylist()]
            out = [b.column(n) for n in names]
            out += [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, ids_col, count_col])

    return source.mapInArrow(run, schema)


def decode(
    df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded", digest_only: bool = False
) -> DataFrame:
    """df with ``out_col`` binary: the raw bytes of the ids in ``ids_col`` (null: none). An id without a rank is an error.

    With digest_only the column is a string, the SHA-256 of the bytes in lower-case hex; the bytes stay in the worker.
    """
    kept, schema = appended(df, [(out_col, T.StringType() if digest_only else T.BinaryType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, ids_col, SLICE_BYTES):
            texts = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(ids_col).to_pylist()]
            found = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()) if digest_only else pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], found], names=[*names, out_col])

    return kept.mapInArrow(run, schema)
