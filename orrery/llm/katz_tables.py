"""Stored n-gram tables of a Katz back-off model of any order, for scoring other texts.

``katz.score`` learns from a corpus and scores it in one go, for pairs; here the same model, with histories of up to
``order`` - 1 tokens, is written as tables that any later job can read:

    grams    (n, h, w, c, p): an n-gram of training as hashes of its history and last token, its count and probability
    weights  (n, h, a): the back-off weight of each history of n - 1 tokens

both partitioned by n and a hash of the history. The probability of a token is found by recursion over the orders:

    p_n(w | h) = kept_n(c(h, w)) / c(h)            if training has the n-gram
               = a_n(h) * p_(n-1)(w | h')          else, h' being h without its first token; a_n = 1 for an unknown history
    p_1(w)     = kept_1(c(w)) / N, or what these leave for a token that training lacks

kept_n are counts after Good-Turing discounts (``katz.discounts``) of that order's own counts of counts. Weights make the
probabilities after each history sum to one exactly: whatever follows h has been counted after h' too.

Null texts have the end token alone; before the first token stand ``order`` - 1 start marks. Rows of a repeated id each
count. Skewed histories are joins of many rows with one, which adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, words_of
from .katz import ABOVE, CUT, Model, discounts, is_training

#: Marks that no word can be, as words hold no spaces.
END, START = " end", " start"
#: Parts of each order's tables.
PARTS = 32


def _tokens(docs: DataFrame, text_col: str, order: int) -> Column:
    """Hashes of the tokens of a text after the start marks."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), upper, upper.lower())
    marks = F.array_repeat(F.lit(START), order - 1)
    return F.transform(F.concat(marks, words_of(text), F.array(F.lit(END))), lambda x: F.xxhash64(x))


def _history(tokens: Column, last: Column, n: int) -> Column:
    """The hash of the n - 1 tokens before place ``last``; the same number for all if n is 1."""
    return F.xxhash64(F.lit(n), *[F.get(tokens, last - k) for k in range(n - 1, 0, -1)])


def positions(docs: DataFrame, text_col: str, order: int, keep: list[str]) -> DataFrame:
    """keep and, for each token of each row, w and the histories h1 .. h<order>."""
    coded = docs.select(*keep, _tokens(docs, text_col, order).alias("__t"))
    each = coded.select(*keep, "__t", F.explode(F.sequence(F.lit(order - 1), F.size("__t") - 1)).alias("__i"))
    return each.select(*keep, F.get("__t", F.col("__i")).alias("w"), *[_history(F.col("__t"), F.col("__i"), n).alias(f"h{n}") for n in range(1, order + 1)])


def _kept(d: list[float]) -> Column:
    """Discounted counts from the column c."""
    low = F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least("c", F.lit(CUT)) + 1).cast("int")) * F.col("c")
    return F.when(F.col("c") <= CUT, low).otherwise(F.col("c") - ABOVE)


def train(docs: DataFrame, path: str, order: int = 3, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None) -> None:
    """Write the tables of a model of the training rows to the folder ``path``."""
    learned = docs.where(F.coalesce(is_training(id_col) if training is None else training, F.lit(False)))
    seen = positions(learned, text_col, order, [])
    # Longest n-grams once; shorter ones are sums over them, each counted before the shuffle.
    top = materialize(seen.groupBy("w", *[f"h{n}" for n in range(1, order + 1)]).agg(F.count("*").alias("c")), "grams")
    before, kinds = None, []
    for n in range(1, order + 1):
        lower = f"h{max(n - 1, 1)}"
        # A history's own end is part of it, so a gram has one lower history.
        grams = top.groupBy(F.col(f"h{n}").alias("h"), "w").agg(F.sum("c").alias("c"), F.first(lower).alias("lower"))
        grams = materialize(grams, f"grams{n}")
        small = {r["c"]: r["types"] for r in grams.where(F.col("c") <= CUT + 1).groupBy("c").agg(F.count("*").alias("types")).collect()}
        all_types, total = grams.agg(F.count("*"), F.sum("c")).first()
        stats = [small.get(k, 0) for k in range(CUT + 2)]
        own = grams.groupBy("h").agg(F.sum("c").alias("ch"))
        grams = grams.join(own, "h").withColumn("p", _kept(discounts(stats)) / F.col("ch")).select("h", "w", "c", "p", "lower")
        grams = materialize(grams, f"scored{n}")
        if n == 1:
            model = Model([*stats, all_types, total or 0], [0] * (CUT + 4))
            kinds.append((1, float(model.unknown), int(total or 0), int(all_types)))
        else:
            below = before.select(F.col("h").alias("lower"), "w", F.col("p").alias("q"))
            sums = grams.join(below, ["lower", "w"]).groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
            weights = sums.select(F.lit(n).alias("n"), "h", ((1 - F.col("p")) / (1 - F.col("q"))).alias("a"))
            weights.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")).hint("rebalance", "part").write.partitionBy("n", "part").mode(
                "append" if n > 2 else "error"
            ).parquet(f"{path}/weights")
        stored = grams.select(F.lit(n).alias("n"), "h", "w", "c", "p").withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
        stored.hint("rebalance", "part").write.partitionBy("n", "part").mode("append" if n > 1 else "error").parquet(f"{path}/grams")
        before = grams
    docs.sparkSession.createDataFrame([(order, *kinds[0][1:])], "order int, unknown double, tokens long, types long").coalesce(1).write.parquet(f"{path}/model")


@dataclass
class Tables:
    """A stored model."""

    order: int
    unknown: float
    tokens: int
    types: int
    grams: DataFrame
    weights: DataFrame | None


def load(spark: SparkSession, path: str) -> Tables:
    m = spark.read.parquet(f"{path}/model").first()
    grams = spark.read.schema("h long, w long, c long, p double, n int, part int").parquet(f"{path}/grams")
    weights = spark.read.schema("h long, a double, n int, part int").parquet(f"{path}/weights") if m["order"] > 1 else None
    return Tables(m["order"], m["unknown"], m["tokens"], m["types"], grams, weights)


def probabilities(contexts: DataFrame, model: Tables) -> DataFrame:
    """contexts (w, h1 .. h<order>) with ``p``, the token's probability after its longest history."""
    out = contexts
    for n in range(1, model.order + 1):
        grams = model.grams.where(F.col("n") == n).select(F.col("h").alias(f"h{n}"), "w", F.col("p").alias(f"__p{n}"))
        out = out.join(grams, [f"h{n}", "w"], "left")
        if n > 1:
            weights = model.weights.where(F.col("n") == n).select(F.col("h").alias(f"h{n}"), F.col("a").alias(f"__a{n}"))
            out = out.join(weights, f"h{n}", "left")
    p = F.coalesce(F.col("__p1"), F.lit(model.unknown))
    for n in range(2, model.order + 1):
        p = F.coalesce(F.col(f"__p{n}"), F.coalesce(F.col(f"__a{n}"), F.lit(1.0)) * p)
    return out.select(*contexts.columns, p.alias("p"))


def score(docs: DataFrame, model: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of every row, by the stored tables; other columns are left behind."""
    numbered = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    histories = [f"h{n}" for n in range(1, model.order + 1)]
    # Each different context is looked up once, however often texts have it.
    each = materialize(positions(numbered, "text", model.order, ["row"]).groupBy("row", "w", *histories).agg(F.count("*").alias("times")), "contexts")
    known = materialize(probabilities(each.select("w", *histories).distinct(), model), "probabilities")
    sums = each.join(known, ["w", *histories]).groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10("p")).alias("score"))
    return numbered.join(sums, "row").select(F.col("id").alias(id_col), "n_tokens", "score")
