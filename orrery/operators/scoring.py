"""Rubric scores: validation, aggregation over tasks and iterations, cost, and a runner for any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import even_round, on_grid

# Fixed values.
TASKS, TASK_CHARS, REASON_CHARS, OVERALL_CHARS = (6, 12), (30, 300), (30, 350), (150, 2500)
SUPPLY_LABELS = ("R0", "R1", "R2")
PRICE_PER_MILLION = {"input": 1.00, "output": 5.00, "cache_write": 1.25, "cache_read": 0.10}
#: (tickers, lowest, highest expected score)
ANCHORS = (
    (("ZS", "DDOG", "CRWD"), None, 55.0),
    (("HUBS", "LPSN", "EGAN", "ZIP"), 60.0, None),
    (("PFE",), None, 60.0),
    (("VEEV",), 25.0, 55.0),
    (("PAYC",), 35.0, 75.0),
    (("MCO", "SPGI", "MSCI", "COUR", "CHGG"), None, None),
)


def rho(n: Column, r1: Column, r2: Column) -> Column:
    """The score of n tasks: full weight for R1, half for R2, on a scale of 1 to 100, one place, half to even."""
    raw = (r1 + r2 * F.lit(0.5)) / F.nullif(n, F.lit(0))
    return even_round((raw * 99 + 1).cast("decimal(18,9)"), 1).cast("double")


def supply_scores(tasks: DataFrame, keys: list[str], label: str = "r_label") -> DataFrame:
    r1, r2 = F.count_if(F.col(label) == "R1"), F.count_if(F.col(label) == "R2")
    return tasks.groupBy(*keys).agg(F.count("*").alias("n_tasks"), r1.alias("n_r1"), r2.alias("n_r2")).withColumn(
        "rho", rho(F.col("n_tasks"), F.col("n_r1"), F.col("n_r2"))
    )


def _within(text: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(F.length(text).between(*bounds), F.lit(False))


def supply_violations(payload: Column) -> Column:
    """What a payload of tasks breaks: struct<ticker, tasks: array<struct<task, r_label, reasoning>>, overall_reasoning>."""
    tasks = payload["tasks"]
    checks = {
        "task count": F.size(tasks).between(*TASKS),
        "task length": F.forall(tasks, lambda t: _within(t["task"], TASK_CHARS)),
        "reasoning length": F.forall(tasks, lambda t: _within(t["reasoning"], REASON_CHARS)),
        "label": F.forall(tasks, lambda t: F.coalesce(t["r_label"].isin(*SUPPLY_LABELS), F.lit(False))),
        "overall length": _within(payload["overall_reasoning"], OVERALL_CHARS),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def demand_violations(switch: Column, error: Column, data: Column, composite: Column) -> Column:
    """What three scores and their composite break: range, the grid of tenths, the mean within 0.005."""
    out = []
    for name, v in (("switch", switch), ("error", error), ("data", data)):
        out.append(F.when(~F.coalesce(v.between(0, 1), F.lit(False)), F.lit(f"{name} range")))
        out.append(F.when(~F.coalesce(on_grid(v), F.lit(False)), F.lit(f"{name} grid")))
    mean = even_round((switch + error + data) / 3, 3)
    out.append(F.when(~F.coalesce(F.abs(composite - mean) <= 0.005 + 1e-12, F.lit(False)), F.lit("composite")))
    return F.array_compact(F.array(*out))


def over_iterations(scores: DataFrame, key: str, value: str = "rho") -> DataFrame:
    """Mean and sample deviation of the rounded scores, two places; a null deviation of fewer than two."""
    return scores.groupBy(key).agg(
        F.count(value).alias("n_iterations"), even_round(F.avg(value), 2).alias("rho_mean"), even_round(F.stddev_samp(value), 2).alias("rho_std")
    )


def cost(tokens: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for kind, n in tokens.items():
        out = out + n * F.lit(PRICE_PER_MILLION[kind] / 1e6)
    return out


def anchor_checks(scores: DataFrame, key: str = "ticker", value: str = "rho_mean") -> DataFrame:
    """OK, WARN or INFO for each score that has an expectation."""
    rules = [(t, low, high) for tickers, low, high in ANCHORS for t in tickers]
    table = scores.sparkSession.createDataFrame(rules, f"{key} string, low double, high double")
    v = F.col(value)
    fits = F.coalesce(v >= F.col("low"), F.lit(True)) & F.coalesce(v <= F.col("high"), F.lit(True))
    free = F.col("low").isNull() & F.col("high").isNull()
    return scores.join(F.broadcast(table), key).withColumn("verdict", F.when(free, "INFO").when(fits, "OK").otherwise("WARN"))


#: Rows of tasks that a worker gathers before it hands them on.
OUT_ROWS = 20_000


def keyword_scorer(text: str, iteration: int) -> list[dict]:
    """A scorer that needs no network: all sentences as tasks, labelled by words that they hold."""
    rules = (("R0", ("real", "secur", "hard")), ("R1", ("text", "writ", "doc")))
    out = []
    for s in [x.strip() for x in (text or "").split(".") if x.strip()]:
        label = next((r for r, hints in rules if any(h in s.lower() for h in hints)), "R2")
        out.append({"task": s[: TASK_CHARS[1]], "r_label": label})
    return out


#: What a scorer gets after an attempt that failed.
RETRY = "{text}\n\nThe last answer was not valid: {error}\nAnswer again."
#: Part of what the first call of a prompt wrote to the cache that later calls have to read.
CACHE_PART = 0.95


def cache_verdicts(usage: DataFrame, prompt: str = "prompt_hash", order: str = "call") -> DataFrame:
    """usage with ``verdict`` of each call: whether the first of a prompt wrote to the cache and later ones read it back.

    usage: prompt, order (different within a prompt), cache_creation, cache_read long. Verdicts: write_ok, no_write,
    read_ok, rewritten (read back, yet written again), miss. Later calls of a prompt whose first wrote nothing count as first.
    """
    wrote = F.coalesce(F.col("cache_creation"), F.lit(0))
    before = Window.partitionBy(prompt).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.first(F.when(wrote > 0, wrote), ignorenulls=True).over(before)
    verdict = (
        F.when(F.col("__size").isNull() & (wrote > 0), "write_ok")
        .when(F.col("__size").isNull(), "no_write")
        .when(F.coalesce(F.col("cache_read"), F.lit(0)) < CACHE_PART * F.col("__size"), "miss")
        .when(wrote > 0, "rewritten")
        .otherwise("read_ok")
    )
    return usage.withColumn("__size", size).withColumn("verdict", verdict).drop("__size")


def run_scorer(
    docs: DataFrame, key: str, text_col: str = "text", iterations: int = 1, attempts: int = 3,
    scorer: Callable[[str, int], list[dict]] = keyword_scorer,
) -> DataFrame:
    """(key, iteration, task, r_label, error) from a scorer called for each text and iteration, tried again on errors.

    All iterations of a text have to succeed: else it has one row with the last error and no tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[text_col], strict=True):
                rows, error = [], None
                for i in range(1, iterations + 1):
                    error = None
                    for _ in range(attempts):
                        # What went wrong is told with the next attempt.
                        asked = text if error is None else RETRY.format(text=text or "", error=error)
                        try:
                            rows += [(k, i, t["task"], t["r_label"], None) for t in scorer(asked, i)]
                            error = None
                            break
                        except Exception as e:  # a scorer may fail in any way; the error is the result
                            error = str(e)[:500]
                    if error is not None:
                        rows = [(k, i, None, None, error)]
                        break
                out += rows
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    kind, names = docs.schema[key].dataType.simpleString(), [key, "iteration", "task", "r_label", "error"]
    return docs.select(key, text_col).mapInPandas(run, f"{key} {kind}, iteration int, task string, r_label string, error string")
