"""Queries of batched fixed-effects regressions, and the SQL that checks them by repeated demeaning and elimination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import fits
from ..operators.fits import Fit, Term

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The quarter of the shock.
SHOCK = "1998Q4"


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by quarter, with the quarters that they have orders in: outcomes, scores, and columns that are 1 at times."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", calendar.quarter_label(F.col("o_orderdate")).alias("quarter"), F.col("o_totalprice").cast("double").alias("price"),
        (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
    )
    cells = orders.groupBy(F.col("o_custkey").alias("firm"), "quarter").agg(
        F.ln(F.sum("price")).alias("ln_total"), F.count("*").cast("double").alias("n_orders"), F.ln(F.avg("price")).alias("ln_mean"),
        F.avg("urgent").alias("urgent"), F.when(F.count("*") > 1, F.max("price") / F.min("price")).alias("spread"),
    )
    firms = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("firm"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("double").alias("nation"),
        F.col("c_acctbal").cast("double").alias("rho"), (F.col("c_nationkey") / 24.0).alias("delta"),
        ((F.col("c_acctbal").cast("double") + 1000) / 11000 * (1 - F.col("c_nationkey") / 24.0)).alias("exposure"),
    )
    return cells.join(firms, "firm").withColumn("post", (F.col("quarter") >= SHOCK).cast("int"))


OUTCOMES = ("ln_total", "n_orders", "ln_mean", "urgent", "spread")
SAMPLES = {
    "all": "true", "building": "segment = 'BUILDING'", "poor": "rho < 2000", "near": "nation < 12",
}

_PANEL_SQL = f"""
cells AS (SELECT o_custkey AS firm, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, ln(sum(CAST(o_totalprice AS DOUBLE))) AS ln_total,
    CAST(count(*) AS DOUBLE) AS n_orders, ln(avg(CAST(o_totalprice AS DOUBLE))) AS ln_mean, avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS urgent,
    CASE WHEN count(*) > 1 THEN max(CAST(o_totalprice AS DOUBLE)) / min(CAST(o_totalprice AS DOUBLE)) END AS spread FROM orders GROUP BY ALL),
panel AS (SELECT cells.*, c_mktsegment AS segment, CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_acctbal AS DOUBLE) AS rho, c_nationkey / 24.0::DOUBLE AS delta,
    (CAST(c_acctbal AS DOUBLE) + 1000) / 11000 * (1 - c_nationkey / 24.0::DOUBLE) AS exposure, CAST(quarter >= '{SHOCK}' AS DOUBLE) AS post
  FROM cells JOIN customer ON c_custkey = firm)"""


def _estimates_sql(k: int, sweeps: int) -> str:
    """From design(fit, firm, quarter, y, x1 .. xk): demeaned by turns, then eliminated; estimates(fit, i, beta, se, g, n)."""
    xs = [f"x{i}" for i in range(1, k + 1)]
    each = lambda by: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY fit, {by}) AS {c}" for c in ["y", *xs])
    return f"""
turns(turn, fit, rid, firm, quarter, y, {", ".join(xs)}) AS (SELECT 0, fit, row_number() OVER (), firm, quarter, y, {", ".join(xs)} FROM design
  UNION ALL SELECT turn + 1, fit, rid, firm, quarter, {each("quarter")} FROM
    (SELECT turn, fit, rid, firm, quarter, {each("firm")} FROM turns WHERE turn < {sweeps})),
flat AS (SELECT * FROM turns WHERE turn = {sweeps}),
long AS (SELECT fit, firm, rid, unnest(range(0, {k + 1})) AS j, unnest([y, {", ".join(xs)}]) AS v FROM flat),
gram AS (SELECT a.fit, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM long a JOIN long b ON a.fit = b.fit AND a.rid = b.rid GROUP BY ALL),
solved(p, fit, i, j, v) AS (SELECT 0, fit, i, j, v FROM gram
  UNION ALL SELECT s.p + 1, s.fit, s.i, s.j, CASE WHEN s.i = s.p + 1 AND s.j = s.p + 1 THEN 1 / pp.v WHEN s.i = s.p + 1 THEN s.v / pp.v
      WHEN s.j = s.p + 1 THEN -s.v / pp.v ELSE s.v - ip.v * pj.v / pp.v END
    FROM solved s JOIN solved pp ON pp.fit = s.fit AND pp.i = s.p + 1 AND pp.j = s.p + 1 JOIN solved ip ON ip.fit = s.fit AND ip.i = s.i AND ip.j = s.p + 1
      JOIN solved pj ON pj.fit = s.fit AND pj.i = s.p + 1 AND pj.j = s.j WHERE s.p < {k}),
beta AS (SELECT fit, i, v AS beta FROM solved WHERE p = {k} AND j = 0 AND i > 0),
inv AS (SELECT fit, i, j, v FROM solved WHERE p = {k} AND i > 0 AND j > 0),
resid AS (SELECT flat.fit, firm, rid, any_value(y) - sum(beta * [{", ".join(xs)}][i]) AS e FROM flat JOIN beta ON beta.fit = flat.fit GROUP BY ALL),
scores AS (SELECT long.fit, long.firm, j, sum(v * e) AS s FROM long JOIN resid ON resid.fit = long.fit AND resid.rid = long.rid WHERE j > 0 GROUP BY ALL),
size AS (SELECT fit, count(*) AS n, count(DISTINCT firm) AS g, count(DISTINCT quarter) AS t FROM flat GROUP BY fit),
meat AS (SELECT a.fit, a.j AS i, b.j AS j, sum(a.s * b.s) AS m FROM scores a JOIN scores b ON a.fit = b.fit AND a.firm = b.firm GROUP BY ALL),
cov AS (SELECT x.fit, x.i, y.j, sum(x.v * m * y.v) * any_value(g / (g - 1) * (n - 1) / (n - t - {k})) AS v
  FROM inv x JOIN meat ON meat.fit = x.fit AND meat.i = x.j JOIN inv y ON y.fit = x.fit AND y.i = meat.j JOIN size ON size.fit = x.fit GROUP BY ALL),
estimates AS (SELECT beta.fit, beta.i, beta, sqrt(v) AS se, g, n FROM beta JOIN cov ON cov.fit = beta.fit AND cov.i = beta.i AND cov.j = beta.i JOIN size ON size.fit = beta.fit)"""


def _battery_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{s}|{o}' AS fit, firm, quarter, {o} AS y, rho, post FROM panel WHERE {where} AND {o} IS NOT NULL" for s, where in SAMPLES.items() for o in OUTCOMES
    )
    return f"""
WITH RECURSIVE {_PANEL_SQL}, stacked AS ({each}),
design AS (SELECT fit, firm, quarter, y, post * (rho - avg(rho) OVER (PARTITION BY fit)) / stddev_samp(rho) OVER (PARTITION BY fit) AS x1 FROM stacked),
{_estimates_sql(1, 80)},
signs AS (SELECT firm, draw, CASE WHEN left(md5(firm || '-' || draw), 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT firm FROM design), range(1, {DRAWS + 1}) r(draw)),
drawn AS (SELECT scores.fit, draw, sum(sign * s) AS s FROM scores JOIN signs ON signs.firm = scores.firm GROUP BY ALL),
p AS (SELECT drawn.fit, avg(CAST(abs(s * inv.v) >= abs(beta) AS DOUBLE)) AS p FROM drawn JOIN inv ON inv.fit = drawn.fit JOIN beta ON beta.fit = drawn.fit GROUP BY drawn.fit)
SELECT split_part(estimates.fit, '|', 1) AS sample, split_part(estimates.fit, '|', 2) AS outcome, round_even(beta, 6) + 0.0 AS beta, round_even(se, 6) AS se, round_even(p, 6) AS p,
  g AS n_clusters, n AS n_obs FROM estimates JOIN p ON p.fit = estimates.fit WHERE g >= 10"""


DRAWS = 199


@query("did_battery", _battery_sql())
def did_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outcomes in four samples of a panel with holes, all at once."""
    term = Term("rho", ("rho",), "post")
    asked = [Fit(f"{s}|{o}", o, (term,), F.expr(where)) for s, where in SAMPLES.items() for o in OUTCOMES]
    found = fits.estimate(customer_panel(spark, sf_dir), asked, "firm", "quarter", DRAWS).coefficients
    at = F.split("fit", r"\|")
    return found.select(
        at[0].alias("sample"), at[1].alias("outcome"), (F.bround("beta", 6) + 0.0).alias("beta"), F.bround("se", 6).alias("se"),
        F.bround("p", 6).alias("p"), "n_clusters", "n_obs",
    )


#: Quarters from the shock, those at the ends with all beyond; the one before the shock is what others are compared with.
EVENT = (-4, -3, -2, 0, 1, 2, 3, 4)


def _event_column(k: int) -> str:
    at = "least(4, greatest(-4, distance))"
    return f"CASE WHEN {at} = {k} THEN 1.0 ELSE 0.0 END"


_DISTANCE = f"(CAST(left(quarter, 4) AS INT) * 4 + CAST(right(quarter, 1) AS INT) - {int(SHOCK[:4]) * 4 + int(SHOCK[-1])})"
_EVENT_SQL = f"""
WITH RECURSIVE {_PANEL_SQL}, z AS (SELECT *, (exposure - avg(exposure) OVER ()) / stddev_samp(exposure) OVER () AS z, {_DISTANCE} AS distance FROM panel),
design AS (SELECT 'event' AS fit, firm, quarter, ln_total AS y, {", ".join(f"{_event_column(k)} * z AS x{i + 1}" for i, k in enumerate(EVENT))} FROM z),
{_estimates_sql(len(EVENT), 24)}"""


def _event(spark: SparkSession, sf_dir: str) -> fits.Estimates:
    panel = customer_panel(spark, sf_dir).withColumn("distance", F.expr(_DISTANCE))
    for k in EVENT:
        panel = panel.withColumn(f"at{k}", F.expr(_event_column(k)))
    terms = tuple(Term(str(k), ("exposure",), f"at{k}") for k in EVENT)
    leads = tuple(str(k) for k in EVENT if k < 0)
    return fits.estimate(panel, [Fit("event", "ln_total", terms)], "firm", "quarter", 0, {"event": leads})


@query(
    "event_study",
    f"""{_EVENT_SQL} SELECT CAST({list(EVENT)}[i] AS INT) AS distance, round_even(beta, 6) + 0.0 AS beta, round_even(se, 6) AS se, g AS n_clusters, n AS n_obs FROM estimates""",
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of exposure by quarters before and after the shock."""
    found = _event(spark, sf_dir).coefficients
    return found.select(F.col("term").cast("int").alias("distance"), (F.bround("beta", 6) + 0.0).alias("beta"), F.bround("se", 6).alias("se"), "n_clusters", "n_obs")


@query(
    "event_study_pretrend",
    f"""{_EVENT_SQL}, lead(p, i, j, v) AS (SELECT 0, i, j, v FROM cov WHERE i <= 3 AND j <= 3
  UNION ALL SELECT s.p + 1, s.i, s.j, CASE WHEN s.i = s.p + 1 AND s.j = s.p + 1 THEN 1 / pp.v WHEN s.i = s.p + 1 THEN s.v / pp.v
      WHEN s.j = s.p + 1 THEN -s.v / pp.v ELSE s.v - ip.v * pj.v / pp.v END
    FROM lead s JOIN lead pp ON pp.i = s.p + 1 AND pp.j = s.p + 1 JOIN lead ip ON ip.i = s.i AND ip.j = s.p + 1 JOIN lead pj ON pj.i = s.p + 1 AND pj.j = s.j WHERE s.p < 3)
SELECT 3 AS n_terms, round_even(sum(a.beta * v * b.beta) / 3, 6) AS f FROM lead JOIN beta a ON a.i = lead.i JOIN beta b ON b.i = lead.j WHERE p = 3""",
)
def event_study_pretrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the effects before the shock differ from none, tested together."""
    return _event(spark, sf_dir).joint.select("n_terms", F.bround("f", 6).alias("f"))


_SCORES_SQL = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z_{c}" for c in ("rho", "delta", "exposure"))


@query(
    "triple_interaction",
    f"""WITH RECURSIVE {_PANEL_SQL}, z AS (SELECT *, {_SCORES_SQL} FROM panel),
design AS (SELECT 'triple' AS fit, firm, quarter, ln_total AS y, post * z_rho AS x1, post * z_delta AS x2, post * z_rho * z_delta AS x3 FROM z),
{_estimates_sql(3, 24)}
SELECT ['rho', 'delta', 'rho_delta'][i] AS term, round_even(beta, 6) + 0.0 AS beta, round_even(se, 6) AS se, false AS dropped FROM estimates
UNION ALL SELECT 'rho_again', NULL, NULL, true""",
)
def triple_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply, demand and their product after the shock; a column that repeats one of them is told and left out."""
    terms = (
        Term("rho", ("rho",), "post"), Term("delta", ("delta",), "post"), Term("rho_delta", ("rho", "delta"), "post"), Term("rho_again", ("rho",), "post"),
    )
    found = fits.estimate(customer_panel(spark, sf_dir), [Fit("triple", "ln_total", terms)], "firm", "quarter", 0).coefficients
    return found.select("term", (F.bround("beta", 6) + 0.0).alias("beta"), F.bround("se", 6).alias("se"), "dropped")


@query(
    "effective_exposure",
    f"""WITH RECURSIVE {_PANEL_SQL}, z AS (SELECT *, {_SCORES_SQL} FROM panel),
design AS (SELECT 'exposure' AS fit, firm, quarter, ln_total AS y, post * z_exposure AS x1 FROM z), {_estimates_sql(1, 24)}
SELECT round_even(beta, 6) + 0.0 AS beta, round_even(se, 6) AS se, g AS n_clusters, n AS n_obs FROM estimates""",
)
def effective_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single coefficient of supply where demand lets it through."""
    one = Fit("exposure", "ln_total", (Term("exposure", ("exposure",), "post"),))
    found = fits.estimate(customer_panel(spark, sf_dir), [one], "firm", "quarter", 0).coefficients
    return found.select((F.bround("beta", 6) + 0.0).alias("beta"), F.bround("se", 6).alias("se"), "n_clusters", "n_obs")


_STAGES = (("early", f"quarter >= '{SHOCK}' AND quarter < '2000Q1'"), ("advanced", "quarter >= '2000Q1'"))
_P_SQL = f"""
signs AS (SELECT firm, draw, CASE WHEN left(md5(firm || '-' || draw), 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT firm FROM design), range(1, {DRAWS + 1}) r(draw)),
drawn AS (SELECT scores.fit, draw, sum(sign * s) AS s FROM scores JOIN signs ON signs.firm = scores.firm GROUP BY ALL)
SELECT beta.fit AS term, round_even(any_value(beta), 6) + 0.0 AS beta, round_even(any_value(se), 6) AS se, round_even(avg(CAST(abs(s * inv.v) >= abs(beta) AS DOUBLE)), 6) AS p
FROM drawn JOIN inv ON inv.fit = drawn.fit JOIN (SELECT fit, beta, se FROM estimates) beta ON beta.fit = drawn.fit GROUP BY beta.fit"""


@query(
    "period_p_values",
    f"""WITH RECURSIVE {_PANEL_SQL}, z AS (SELECT *, (rho - avg(rho) OVER ()) / stddev_samp(rho) OVER () AS z FROM panel),
design AS ({" UNION ALL ".join(f"SELECT '{name}' AS fit, firm, quarter, ln_total AS y, CAST({when} AS DOUBLE) * z AS x1 FROM z" for name, when in _STAGES)}),
{_estimates_sql(1, 40)}, {_P_SQL}""",
)
def period_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of each period after the shock by itself, from one table of draws."""
    panel = customer_panel(spark, sf_dir)
    for name, when in _STAGES:
        panel = panel.withColumn(f"is_{name}", F.expr(when).cast("int"))
    asked = [Fit(name, "ln_total", (Term(name, ("rho",), f"is_{name}"),)) for name, _ in _STAGES]
    found = fits.estimate(panel, asked, "firm", "quarter", DRAWS).coefficients
    return found.select("term", (F.bround("beta", 6) + 0.0).alias("beta"), F.bround("se", 6).alias("se"), F.bround("p", 6).alias("p"))
