"""Risk-controlled quality rules, in DataFrame functions alone.

A document is rejected by the base rules (too few words, too many repeated ones) or by a calibrated rule: a metric at or
above the cutoff of the document's stratum. Cutoffs come from labelled holdouts. Per stratum and rule, a fixed ladder of
cutoffs is tested from the mildest to the strictest; a step is taken while the exact binomial test shows, at level
``delta`` divided by the number of strata times rules (Bonferroni), that the share of good documents it would reject is
under ``alpha`` divided by the number of rules. The ladder is fixed in advance and stops at the first step that fails,
so the steps of a ladder need no further correction. With probability 1 - delta, therefore, in no stratum do the
calibrated rules together reject more than a share ``alpha`` of good documents.

Null texts have no words; null strata form a stratum of their own; strata without enough labels have no cutoffs. Labels
of a document that is labelled more than once count as good only if all are. Documents are matched to labels by id, and
rows of a repeated document id each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, materialize, words_of

#: Rule: the ladder of cutoffs, mildest first. A value at or above a cutoff is rejected.
LADDERS = {
    "symbol_ratio": [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04],
    "exclaim_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.08, 0.06],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0],
}
ALPHA, DELTA = 0.01, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Up to so many repeated windows in a text are looked up one by one; beyond, the windows are sorted with their places.
FEW = 64
SYMBOLS = "#*$%&|<>"
#: Strata up to which the table of cutoffs is broadcast; a larger one is joined by a shuffle.
BROADCAST_STRATA = 10_000

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]


def _let(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count_of(text: Column, chars: str) -> Column:
    """How often any of the characters (one byte each) occurs; replacing is a scan of bytes."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(counts[1:], counts[0]).cast("long")


def _covered(found: Column) -> Column:
    """How many words stand in the windows that begin at the ascending positions ``found``."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("end"))

    def step(acc: Column, at: Column) -> Column:
        last = at.cast("long") + (WINDOW - 1)
        return F.struct(
            (acc["total"] + F.least(F.lit(WINDOW).cast("long"), last - acc["end"])).alias("total"), last.alias("end")
        )

    return F.aggregate(found, zero, step, lambda acc: acc["total"])


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur more than once in the array; windows are compared by a 64-bit hash of their words."""

    def by_sorting(s: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.coalesce(F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.lit(False))
            | F.coalesce(F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        return _covered(F.sort_array(F.transform(at, lambda i: F.get(s, i)["p"])))

    def by_lookup(h: Column, twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return _covered(F.array_compact(at))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        sorted_ = F.sort_array(h)
        twice = _let(sorted_, lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        found = _let(
            twice, lambda d: F.when(F.size(d) <= FEW, by_lookup(h, d)).otherwise(_let(pairs, by_sorting))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return _let(hashes, of_hashes)


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns METRICS (long) and base_failed; columns of these names are replaced."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = words_of(text)
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            _repeated_words(w).alias("repeat"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_lines = _let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))
    )
    taken = {n.lower() for n in [*METRICS, "base_failed", "__w", "__l"]}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    out = docs.select(
        *kept,
        by_words.alias("__w"),
        by_lines.alias("__l"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "!").alias("n_exclaims"),
    )
    return out.select(
        *kept,
        F.col("__w.n").alias("n_words"),
        F.col("__w.chars").alias("word_chars"),
        "n_symbols",
        (F.col("__l.n") - F.col("__l.d")).alias("n_dup_lines"),
        F.col("__w.repeat").alias("n_repeat_words"),
        F.col("__l.n").alias("n_lines"),
        "n_exclaims",
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def rule_values() -> dict[str, Column]:
    """The value of each calibrated rule, from the metrics; null where there is nothing to divide by."""
    chars = F.nullif(F.col("word_chars"), F.lit(0))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "exclaim_ratio": F.col("n_exclaims") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "word_length": F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0)),
    }


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k), summed exactly in logarithms; 1 where k is at or over the mean."""
    start = n * F.log1p(F.lit(-share))
    odds = F.log(F.lit(share / (1 - share)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i.cast("double")) + odds
        top = F.greatest(term, acc["sum"])
        return F.struct(
            term.alias("term"), (top + F.log1p(F.exp(F.least(term, acc["sum"]) - top))).alias("sum")
        )

    zero = F.struct(start.alias("term"), start.alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, step, lambda acc: F.exp(acc["sum"]))
    return F.when(k >= n * share, F.lit(1.0)).when(k <= 0, F.exp(start)).otherwise(total)


def calibrate(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang",
    label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """(stratum, one column for each rule): the strictest cutoff that passed, or null."""
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__good")).where("__good = 1")
    values = rule_values()
    ladder = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(LADDERS[r]).cast("array<double>").alias("cuts"), v.alias("value"))
            for r, v in values.items()
        ]
    )
    held = measured.where(~F.col("base_failed")).select(
        F.col(id_col).alias("__id"), F.col(stratum_col).alias("stratum"), ladder.alias("__r")
    )
    # The number of cutoffs that a value reaches; the ladder falls, so these are its last ones.
    reached = F.size(F.filter(F.col("r.cuts"), lambda c: F.col("r.value") >= c))
    counts = (
        held.join(good, "__id")
        .select("stratum", F.explode("__r").alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), F.coalesce(reached, F.lit(0)).alias("reached"))
        .count()
    )
    counts = materialize(counts, "holdouts")
    strata = counts.select("stratum").distinct().count()
    steps = counts.groupBy("stratum", "rule").agg(
        F.sum("count").alias("n"), F.collect_list(F.struct("reached", "count")).alias("by")
    )
    cuts = F.create_map(*[x for r, c in LADDERS.items() for x in (F.lit(r), F.lit(c).cast("array<double>"))])
    steps = steps.select("stratum", "rule", "n", "by", F.posexplode(F.element_at(cuts, F.col("rule"))).alias("at", "cut"))
    size = steps.withColumn("len", F.size(F.element_at(cuts, F.col("rule"))))
    # A cutoff at place `at` is reached by values that reach len - at cutoffs or more.
    hits = F.aggregate(
        "by", F.lit(0).cast("long"),
        lambda a, x: a + F.when(x["reached"] >= F.col("len") - F.col("at"), x["count"]).otherwise(0),
    )
    share, level = alpha / len(LADDERS), delta / len(LADDERS)
    tested = size.withColumn("hits", hits).withColumn(
        "passed", binomial_tail(F.col("hits"), F.col("n"), share) <= level / max(strata, 1)
    )
    order = Window.partitionBy("stratum", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    taken = tested.withColumn("taken", F.min(F.col("passed").cast("int")).over(order)).where("taken = 1")
    return taken.groupBy("stratum").pivot("rule", list(LADDERS)).agg(F.min("cut"))


def _cutoffs(calibration: DataFrame) -> DataFrame:
    """The cutoffs under names that clash with nothing, marked for broadcast if few."""
    renamed = calibration.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__cut_{r}") for r in LADDERS])
    rows = renamed.limit(BROADCAST_STRATA + 1).collect()
    few = len(rows) <= BROADCAST_STRATA
    return F.broadcast(calibration.sparkSession.createDataFrame(rows, renamed.schema)) if few else renamed


def _judged(measured: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    joined = measured.join(cutoffs, F.col(f"`{stratum_col}`").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r, v in rule_values().items():
        rejected = rejected | F.coalesce(v >= F.col(f"__cut_{r}"), F.lit(False))
    base = [F.col(f"`{c}`") for c in measured.columns if c.lower() != "kept"]
    return joined.select(*base, (~F.col("base_failed") & ~rejected).alias("kept"))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """(id, stratum, METRICS, base_failed, kept) of every row. The texts are read once, their metrics kept in a table."""
    measured = materialize(with_metrics(docs.select(id_col, stratum_col, text_col), text_col).drop(text_col), "metrics")
    calibration = calibrate(measured, labels, id_col, stratum_col, label_col, alpha, delta)
    return _judged(measured, _cutoffs(calibration), stratum_col)


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """docs with the METRICS, base_failed and kept, for use as a filter.

    The documents are written once with their metrics, so that neither the cutoffs nor a filter measures a text again. Texts are
    never shuffled; metrics are, by id, where the good labels are too many for a broadcast.
    """
    measured = materialize(with_metrics(docs, text_col), "measured")
    calibration = calibrate(measured, labels, id_col, stratum_col, label_col, alpha, delta)
    return _judged(measured, _cutoffs(calibration), stratum_col)
