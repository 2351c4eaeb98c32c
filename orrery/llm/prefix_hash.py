"""Document fingerprints from prefix polynomial hashes.

The fingerprint of a text is its array of modular prefix hashes, H(i) = sum of c(j) * B^j mod 2^31 - 1 over j < i, for
two bases. Two spans are equal if H(i + n) - H(i), brought to the same power of B, agree for both; so any span
equality takes constant time and the longest common extension of two places is found by binary search. Published as
text, the fingerprint is the number of characters and the last entry of both arrays: equal texts have equal strings,
and different ones differ but for a chance of about n / 2^31 squared.

Likeness of two fingerprints: the share of both texts that maximal common extensions cover. Extensions start at both
ends and at anchors: windows of ANCHOR characters whose span hash is a multiple of SAMPLE, paired in order of occurrence
where both fingerprints have them. Inserted, deleted and moved passages therefore cost no more than themselves. Two empty
texts have likeness 1, an empty and another text 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width

#: A prime for which a remainder is a shift and a sum, and two bases.
PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
ANCHOR, SAMPLE = 24, 64
#: Up to so many extensions are found one by one.
FEW = 12
#: Ranges of ids for each shuffle partition, so that partitions come out even.
RANGES = 8


_P, _SHIFT = np.uint64(PRIME), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainders of values under 2^62."""
    x = (x & _P) + (x >> _SHIFT)
    x = (x & _P) + (x >> _SHIFT)
    return np.where(x >= _P, x - _P, x)


@lru_cache(maxsize=8)
def _powers(k: int, size: int, inverse: bool) -> np.ndarray:
    """B^0 .. B^(size-1) of the k-th base, or of its inverse; size is a power of two."""
    base = pow(BASES[k], -1, PRIME) if inverse else BASES[k]
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), PRIME)))])
    return out


def _room(n: int) -> int:
    """Tables of powers come in few sizes."""
    return max(1 << 17, 1 << n.bit_length())


class Prefixes:
    """The prefix hashes of one text; ``start`` are those of a text that begins with the same ``shared`` characters."""

    def __init__(self, codes: np.ndarray, start: Prefixes | None = None, shared: int = 0):
        self.n = len(codes)
        self.h = []
        c = codes[shared:].astype(np.uint64) + np.uint64(1)
        for k in range(2):
            h = np.zeros(self.n + 1, np.uint64)
            if shared:
                h[: shared + 1] = start.h[k][: shared + 1]
            # Terms are under 2^31, so that the plain sum of 2^31 of them still fits.
            terms = _mod(c * _powers(k, _room(self.n), False)[shared : self.n])
            h[shared + 1 :] = _mod(np.cumsum(terms) + h[shared])
            self.h.append(h)
        self.ranked = None

    def text(self) -> str:
        return f"{self.n:x}-{int(self.h[0][-1]):08x}{int(self.h[1][-1]):08x}"

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sampled windows, and their hashes with the number of earlier equal ones in the lower bits."""
        if self.ranked is None:
            m = max(self.n - ANCHOR + 1, 0)
            h = self.h[0]
            value = _mod((h[ANCHOR : ANCHOR + m] + _P - h[:m]) * _powers(0, _room(self.n), True)[:m])
            at = np.flatnonzero((value & np.uint64(SAMPLE - 1)) == 0)
            self.ranked = at, _ranked(value[at])
        return self.ranked


def equal(x: Prefixes, i, y: Prefixes, j, n) -> np.ndarray:
    """Whether the spans of n characters at i in x and at j in y are equal, for arrays of places."""
    size = _room(max(x.n, y.n))
    same = True
    for k in range(2):
        power, a, b = _powers(k, size, False), x.h[k], y.h[k]
        same = same & (_mod((a[i + n] + _P - a[i]) * power[j]) == _mod((b[j + n] + _P - b[j]) * power[i]))
    return same


def _equal_one(x: Prefixes, i: int, y: Prefixes, j: int, n: int) -> bool:
    size = _room(max(x.n, y.n))
    for k in range(2):
        power, a, b = _powers(k, size, False), x.h[k], y.h[k]
        left = (int(a[i + n]) - int(a[i])) * int(power[j])
        if (left - (int(b[j + n]) - int(b[j])) * int(power[i])) % PRIME:
            return False
    return True


def _longest(x: Prefixes, i: np.ndarray, y: Prefixes, j: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """By binary search: a common extension of some length has all shorter ones."""
    low, high = np.zeros(len(i), np.int64), room.astype(np.int64)
    if len(i) <= FEW:
        for k in range(len(i)):
            a, b, s, t = 0, int(high[k]), int(i[k]), int(j[k])
            # Most places extend by nothing or in full.
            step = 1
            while a < b:
                n = min(step, b)
                if not _equal_one(x, s - n if back else s, y, t - n if back else t, n):
                    b = n - 1
                    break
                a, step = n, 16 * step
            while a < b:
                n = (a + b + 1) // 2
                if _equal_one(x, s - n if back else s, y, t - n if back else t, n):
                    a = n
                else:
                    b = n - 1
            low[k] = a
        return low
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = equal(x, i - mid, y, j - mid, mid) if back else equal(x, i, y, j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def extend(x: Prefixes, i: np.ndarray, y: Prefixes, j: np.ndarray) -> np.ndarray:
    """The longest common extension to the right of each pair of places."""
    return _longest(x, i, y, j, np.minimum(x.n - i, y.n - j), False)


def extend_back(x: Prefixes, i: np.ndarray, y: Prefixes, j: np.ndarray) -> np.ndarray:
    """The longest common extension to the left of each pair of places."""
    return _longest(x, i, y, j, np.minimum(i, j), True)


def _ranked(values: np.ndarray) -> np.ndarray:
    """Each value with the number of earlier equal ones in the lower bits."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    out = np.empty(len(s), np.uint64)
    out[order] = (s << np.uint64(32)) | rank.astype(np.uint64)
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> int:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    begin = np.maximum(starts, np.r_[0, ends[:-1]])
    return int(np.maximum(ends - begin, 0).sum())


def likeness(x: Prefixes, y: Prefixes) -> float:
    if not x.n or not y.n:
        return float(x.n == y.n)
    if x.n == y.n and x.text() == y.text():
        return 1.0
    (px, hx), (py, hy) = x.anchors(), y.anchors()
    i = j = np.empty(0, np.int64)
    if len(px) and len(py):
        _, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
        i, j = px[ix], py[iy]
    # Anchors of one alignment that lie within one extension give it again: the first of each run on a diagonal is enough.
    if len(i) > 1:
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        along = np.flatnonzero(np.diff(i - j) == 0)
        joined = equal(x, i[along], y, j[along], i[along + 1] - i[along])
        first = np.ones(len(i), bool)
        first[along[joined] + 1] = False
        i, j = i[first], j[first]
    i, j = np.r_[0, i, x.n], np.r_[0, j, y.n]
    back, ahead = extend_back(x, i, y, j), extend(x, i, y, j)
    s, n = i - back, back + ahead
    return (_union(s, s + n) + _union(j - back, j - back + n)) / (x.n + y.n)


def codes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text whose last quarter gives way to the first as many characters (or all) of the following text."""
    n = len(codes) // 4
    return np.concatenate([codes[: len(codes) - n], following[:n]])


def with_following(df: DataFrame, id_col: str, text_col: str, visit, fields: T.StructType) -> DataFrame:
    """visit(id, text, following text) for each row in ascending order of ids, and the least row after the last.

    Rows are dealt out by ranges of ids, and the first row of a range is sent to the range before, too; a text moves once,
    and a task holds two of them. Null ids come first; equal ids are ordered by their texts; a sole row follows itself.
    """
    ids = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"))
    n = RANGES * shuffle_width(df.sparkSession)
    cuts = np.array(sorted(set(ids.approxQuantile("id", [k / n for k in range(1, n)], 1 / (2 * n)))), np.float64).astype(np.int64)

    @F.pandas_udf(T.IntegerType())
    def range_of(col: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, col.to_numpy(), side="right").astype(np.int32))

    # A row for each range comes to the driver.
    firsts = {r["range"]: r["first"] for r in ids.groupBy(range_of("id").alias("range")).agg(F.min("id").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[k - 1] for k, r in enumerate(order)}  # the first of all follows the last

    @F.pandas_udf(T.IntegerType())
    def range_before(col: pd.Series) -> pd.Series:
        return col.map(before).astype("Int32")

    rows = df.select(
        F.col(id_col).cast("long").alias("real"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("*", range_of("id").alias("own"), range_before("id").alias("extra"))
    sent = rows.select(
        "real", "id", "text",
        F.explode(
            F.when(F.col("extra").isNull(), F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("ahead")))).otherwise(
                F.array(
                    F.struct(F.col("own").alias("range"), F.lit(0).alias("ahead")),
                    F.struct(F.col("extra").alias("range"), F.lit(1).alias("ahead")),
                )
            )
        ).alias("to"),
    ).select("to.range", "to.ahead", "real", "id", "text")
    dealt = sent.repartition(shuffle_width(df.sparkSession), "range").sortWithinPartitions("range", "ahead", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its following one
        for b in batches:
            out = []
            columns = [b.column(n).to_pylist() for n in ("range", "ahead", "real", "text")]
            for part, ahead, real, text in zip(*columns, strict=True):
                if held is not None and held[0] == part:
                    out.append(visit(held[1], held[2], text))
                held = None if ahead else (part, real, text)
            yield pa.RecordBatch.from_pylist(out, schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)
    return dealt.select("range", "ahead", "real", "text").mapInArrow(run, fields)


def fingerprint_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, edited_text, edited_fingerprint, near_edited, near_next) of every row.

    Null texts are empty. Other columns of df are left behind.
    """
    fields = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_text", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    last: list = [None, None]  # the following text's fingerprint is the next row's own

    def of(text: str) -> Prefixes:
        if last[0] != text:
            last[:] = [text, Prefixes(codes_of(text))]
        return last[1]

    def visit(real: int | None, text: str, following: str) -> dict:
        x = of(text)
        own = codes_of(text)
        codes = edited(own, codes_of(following))
        e, f = Prefixes(codes, x, len(own) - len(own) // 4), of(following)
        return {
            id_col: real,
            "n_chars": x.n,
            "fingerprint": x.text(),
            "edited_text": codes.tobytes().decode("utf-32-le"),
            "edited_fingerprint": e.text(),
            "near_edited": likeness(x, e),
            "near_next": likeness(x, f),
        }

    return with_following(df, id_col, text_col, visit, fields)
