"""Nearest texts by cosine, and the label that they vote for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW_CONFIDENCE = 0.5
#: The value of each label, in the order in which ties are settled.
LABELS = (("E0", 0.0), ("E2", 0.5), ("E1", 1.0))


#: Queries that meet a piece of the corpus at once, at most.
QUERY_BLOCK = 5_000
#: Numbers in the vectors of a piece of queries or of the corpus, rows below which a piece isn't cut for the sake of more tasks,
#: pairs compared at a time.
PIECE, LEAST_ROWS, PAIRS = 1 << 20, 256, 1 << 21
#: Groups of rows whose best values tell how far down a query's k best can be.
GROUPS = 256


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, match_id, similarity, rank) of the k nearest corpus rows of each query, by cosine; ties by id.

    All pairs are compared: queries and corpus are dealt into pieces of bounded bytes, every piece of queries meets every piece of
    the corpus in one task, and of a piece only a query's own best k go on. Zero vectors are at similarity 0. A similarity is
    null, and comes last, where a vector or one of its numbers is, or where lengths differ; NaN comes first.
    """
    sizes = lambda df: df.agg(F.count("*"), F.sum(F.greatest(F.size(vec_col), F.lit(0)) + 1)).first()
    (m, of_queries), (n, of_corpus) = (map(lambda x: x or 0, sizes(df)) for df in (queries, corpus))
    blocks = max(1, -(-m // QUERY_BLOCK), -(-of_queries // PIECE))
    # At least four tasks for each core, as long as pieces don't get too small; more as memory needs them.
    wanted = min(-(-4 * corpus.sparkSession.sparkContext.defaultParallelism // blocks), n // LEAST_ROWS)
    pieces = max(1, wanted, -(-of_corpus // PIECE))
    own = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def named(df: DataFrame) -> DataFrame:
        v = F.col(vec_col) if df.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).alias("id"), v.alias("v"))

    asked = named(queries).select("id", "v", own(blocks).alias("q"), every(pieces).alias("r"))
    held = named(corpus).select("id", "v", own(pieces).alias("r"), every(blocks).alias("q"))
    of_query, of_match = (df.schema[id_col].dataType.simpleString() for df in (queries, corpus))
    found = asked.groupBy("q", "r").cogroup(held.groupBy("q", "r")).applyInArrow(
        lambda a, b: _best(a, b, k, digits), f"query_id {of_query}, match_id {of_match}, similarity double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length the places of its vectors, the vectors and their norms; those that are null or hold a null aren't there."""
    column, out = column.combine_chunks(), {}
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    if (flat := column.flatten()).null_count:
        length[pc.list_parent_indices(column).filter(flat.is_null()).to_numpy()] = -1
    for n in np.unique(length[length >= 0]).tolist():
        at = np.flatnonzero(length == n)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        out[n] = at, x, np.sqrt(_dots(x, x))
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that of b, summed from the first number to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(queries: pa.Table, rows: pa.Table, k: int, digits: int) -> pa.Table:
    """The k nearest rows of each query, null for rows that can't be compared with it."""
    rows = rows.take(pc.sort_indices(rows.column("id").combine_chunks(), null_placement="at_start"))
    asked, held, places, parts, left = _by_length(queries.column("v")), _by_length(rows.column("v")), np.arange(len(rows)), [], []
    for n, (of_q, q, size_q) in asked.items():
        of_x, x, size_x = held.get(n, (places[:0], None, None))
        if len(of_x):
            at, hit, value = _compared(q, size_q, x, size_x, k, digits)
            parts.append((of_q[at], of_x[hit], value, np.zeros(len(at), bool)))
        left.append((of_q, np.setdiff1d(places, of_x)[: max(0, k - len(of_x))] if len(of_x) < k else places[:0]))
    left.append((np.setdiff1d(np.arange(len(queries)), np.concatenate([a[0] for a in asked.values()] or [places[:0]])), places[:k]))
    parts += [(np.repeat(a, len(b)), np.tile(b, len(a)), np.zeros(len(a) * len(b)), np.ones(len(a) * len(b), bool)) for a, b in left]
    ask, hit, value, null = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return pa.table({
        "query_id": queries.column("id").take(pa.array(ask)), "match_id": rows.column("id").take(pa.array(hit)),
        "similarity": pa.array(value, mask=null, from_pandas=False),
    })


def _compared(q: np.ndarray, size_q: np.ndarray, x: np.ndarray, size_x: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of their k nearest rows, and similarities; ties by place. Similarities are rounded half to even, and
    those that a rounding error could turn are worked out anew in a fixed order of sums, so that they don't depend on the piece."""
    scale, step, many, parts = 10.0**digits, max(1, PAIRS // len(x)), max(1, PIECE // max(1, x.shape[1])), []
    with np.errstate(all="ignore"):
        size_q, size_x = (np.where(n == 0, 1, n) for n in (size_q, size_x))
        unit_q, unit_x = q / size_q[:, None], x / size_x[:, None]
        for s in range(0, len(q), step):
            near = unit_q[s : s + step] @ unit_x.T
            near[np.isnan(near)] = np.inf
            at, hit = np.nonzero(near >= _floor(near, k)[:, None] - 2 / scale)
            value = near[at, hit] * scale
            whole = np.rint(value)
            unsure = np.flatnonzero(np.abs(value - whole) > 0.499)
            for u in (unsure[t : t + many] for t in range(0, len(unsure), many)):
                i, j = at[u] + s, hit[u]
                whole[u] = np.rint(_dots(q[i], x[j]) / size_q[i] / size_x[j] * scale)
            order = np.lexsort((hit, -whole, at))
            at, hit, whole = at[order], hit[order], whole[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            kept = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k
            parts.append((at[kept] + s, hit[kept], whole[kept] / scale + 0.0))
    at, hit, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    value[np.isinf(value)] = np.nan
    return at, hit, value


def _floor(near: np.ndarray, k: int) -> np.ndarray:
    """A value for each query that at least k of its rows reach: the k-th best of the best values of groups, or of all rows."""
    n = near.shape[1]
    if k >= n:
        return np.full(len(near), -np.inf)
    if k <= GROUPS < n:
        size = n // GROUPS
        near = near[:, : size * GROUPS].reshape(len(near), size, GROUPS).max(1)
    return np.partition(near, -k, axis=1)[:, -k]


def voted(matches: DataFrame, key: str = "query_id") -> DataFrame:
    """Of each key's matches (similarity, rank, label, beta): the weighted value, the nearest label, low confidence.

    Negative similarities weigh nothing; where all do, the best match decides and confidence is low.
    """
    w = F.greatest("similarity", F.lit(0.0))
    per = matches.groupBy(key).agg(
        F.sum(w).alias("weight"), F.sum(w * F.col("beta")).alias("sum"), F.count("*").alias("n"),
        F.min_by("label", "rank").alias("top_label"), F.min_by("beta", "rank").alias("top_beta"),
        F.min_by("similarity", "rank").alias("top_similarity"),
    )
    none = F.col("weight") == 0
    beta = F.when(none, F.col("top_beta")).otherwise(F.col("sum") / F.nullif(F.col("weight"), F.lit(0)))
    near = {name: F.abs(F.col("beta") - value) for name, value in LABELS}
    label = F.when((near["E0"] <= near["E2"]) & (near["E0"] <= near["E1"]), "E0").when(near["E2"] <= near["E1"], "E2").otherwise("E1")
    return per.withColumn("beta", beta).select(
        key, F.when(none, F.col("top_label")).otherwise(label).alias("label"), "beta",
        F.when(none, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n_matches_used"),
        (none | (F.col("top_similarity") < LOW_CONFIDENCE)).alias("low_confidence"),
    )


def labelled(matches: DataFrame, strategy: str = "top1", key: str = "query_id") -> DataFrame:
    """(key, label, alpha, beta, gamma, similarity_top1, n_matches_used, strategy, low_confidence) of each key's matches.

    ``top1`` takes the nearest match as it is. ``weighted_majority`` weighs alpha, beta and gamma by similarities above 0 and takes
    the label whose value is next to beta; where no match has weight it falls back to the nearest one, with low confidence, and
    says so in ``strategy``. Matches have (similarity, rank, label, alpha, beta, gamma); a key without any has no row.
    """
    if strategy not in ("top1", "weighted_majority"):
        raise ValueError(f"no strategy: {strategy}")
    names = ("alpha", "beta", "gamma")
    first = matches.groupBy(key).agg(
        *[F.min_by(c, "rank").alias(c) for c in ("label", *names)], F.min_by("similarity", "rank").alias("similarity_top1"),
        *[F.sum(F.greatest("similarity", F.lit(0.0)) * F.col(c)).alias(f"__{c}") for c in names],
        F.sum(F.greatest("similarity", F.lit(0.0))).alias("__weight"), F.count("*").alias("__n"),
    )
    low = F.col("similarity_top1") < LOW_CONFIDENCE
    if strategy == "top1":
        return first.select(key, "label", *names, "similarity_top1", F.lit(1).cast("long").alias("n_matches_used"), F.lit(strategy).alias("strategy"), low.alias("low_confidence"))
    some = F.col("__weight") > 0
    made = first.select(
        key, F.col("label").alias("__label"), "similarity_top1", *[F.when(some, F.col(f"__{c}") / F.col("__weight")).otherwise(F.col(c)).alias(c) for c in names],
        F.when(some, F.col("__n")).otherwise(F.lit(1)).cast("long").alias("n_matches_used"),
        F.when(some, strategy).otherwise(f"{strategy}_fallback_top1").alias("strategy"), (~some | low).alias("low_confidence"), some.alias("__some"),
    )
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("beta") - v), F.lit(k), F.lit(name).alias("name")) for k, (name, v) in enumerate(LABELS)]))["name"]
    return made.select(key, F.when(F.col("__some"), near).otherwise(F.col("__label")).alias("label"), *names, "similarity_top1", "n_matches_used", "strategy", "low_confidence")


def corpus_rows(raw: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Rows of a corpus that have all that is needed."""
    return raw.dropna(subset=list(needed))


def consistency(rows: DataFrame, label: str, value: str) -> DataFrame:
    return rows.groupBy(label).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count("*").alias("n"))
