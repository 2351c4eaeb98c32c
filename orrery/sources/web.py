"""A source over HTTP with spaced requests and retries; the transport is given, so that it works without a network in tests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SPACING = 0.15
WAITS = (2.0, 8.0, 32.0)
AGAIN = frozenset({429, 500, 502, 503, 504})

#: Gives (status, body) for a URL, or raises where the connection fails.
Transport = Callable[[str], tuple[int, bytes]]


def get(url: str, transport: Transport, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of a 200; None for any other answer, at once or, if it is one of AGAIN or no answer, after the last wait."""
    for wait in (*waits, None):
        try:
            status, body = transport(url)
        except OSError:
            status, body = 503, b""
        if status == 200:
            return body
        if status not in AGAIN or wait is None:
            return None
        sleep(wait)
    return None


def fetched(
    urls: DataFrame, transport: Transport, url_col: str = "url", out_col: str = "body", lanes: int = 1,
    spacing: float = SPACING, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """urls with ``out_col`` binary, null where there is nothing to get. Requests of all ``lanes`` together keep the spacing.

    A null URL has a null body and makes no request. Rows that are fetched again after a lost executor are asked for again:
    land the result, as ``tables.land_missing`` does.
    """
    schema = T.StructType([*[f for f in urls.schema.fields if f.name != out_col], T.StructField(out_col, T.BinaryType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = []
            for url in pdf[url_col]:
                if url is None:
                    bodies.append(None)
                    continue
                sleep(spacing * lanes)
                bodies.append(get(url, transport, waits, sleep))
            yield pdf.assign(**{out_col: bodies})[names]

    return urls.repartition(lanes).mapInPandas(run, schema)


def merged_pages(recent: DataFrame, pages: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """recent with each array followed by those of the key's pages in order of ``page``; a page without an array adds nothing."""
    every = recent.select(key, F.lit(-1).alias("page"), *arrays).unionByName(pages.select(key, F.col("page").cast("int").alias("page"), *arrays))
    kept = every.join(recent.select(key).distinct(), key, "left_semi")
    rows = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", *[F.coalesce(F.col(a), F.array().cast(recent.schema[a].dataType)).alias(a) for a in arrays]))).alias("p"))
    return rows.select(key, *[F.flatten(F.col(f"p.{a}")).alias(a) for a in arrays])

