"""The F distribution and what it rests on, as column expressions: intervals and p-values of every group without leaving the JVM.

Arguments are SQL expressions in text, and so are the results of functions that end in ``_sql``: the expressions are long, and text
is made and parsed at once, where columns would be put together call by call. What is used twice is bound by a lambda first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of Lanczos's approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Halvings of a quantile's bracket.
HALVINGS = 60


def _bound(value: str, name: str, use: str) -> str:
    """use, with ``name`` standing for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def log_gamma_sql(x: str) -> str:
    """The logarithm of gamma, for positive x. Below one half, gamma(x) = gamma(x + 1) / x."""
    series = " + ".join([repr(LANCZOS[0]) + "D", *[f"{v!r}D / (lg.z + {k})" for k, v in enumerate(LANCZOS) if k]])
    above = f"0.9189385332046727D + (lg.z + 0.5D) * ln(lg.z + 7.5D) - lg.z - 7.5D + ln({series})"
    z = f"named_struct('x', CAST({x} AS DOUBLE), 'z', CAST({x} AS DOUBLE) - if({x} < 0.5D, 0D, 1D))"
    return _bound(z, "lg", f"if(lg.x < 0.5D, {above} - ln(lg.x), {above})")


def _fraction_sql(a: str, b: str, x: str) -> str:
    """The continued fraction of the incomplete beta function, as many steps as its parameters need."""
    safe = lambda v: f"if(abs({v}) < 1e-300D, 1e-300D, {v})"

    def half(s: str, by: str, name: str) -> str:
        c_and_d = f"named_struct('d', 1 / {safe(f'1 + {name}.by * {name}.s.d')}, 'c', {safe(f'1 + {name}.by / {name}.s.c')}, 'out', {name}.s.out)"
        made = _bound(c_and_d, f"{name}2", f"named_struct('c', {name}2.c, 'd', {name}2.d, 'out', {name}2.out * {name}2.c * {name}2.d)")
        return _bound(f"named_struct('by', {by}, 's', {s})", name, made)

    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    begin = _bound(f"1 - ({a} + {b}) * {x} / ({a} + 1)", "fd", f"named_struct('c', 1D, 'd', 1 / {safe('fd')}, 'out', 1 / {safe('fd')})")
    steps = f"sequence(1, CAST(20 + 4 * sqrt(greatest({a}, {b})) AS INT))"
    return f"aggregate({steps}, {begin}, (s, m) -> {half(half('s', even, 'fe'), odd, 'fo')}, s -> s.out)"


def incomplete_beta_sql(a: str, b: str, x: str) -> str:
    """The regularised incomplete beta function, for positive a and b; x is held to 0 and 1.

    The fraction converges fast below the mean; above it the other tail is taken.
    """
    front = f"{log_gamma_sql('ib.p + ib.q')} - {log_gamma_sql('ib.p')} - {log_gamma_sql('ib.q')} + ib.p * ln(ib.y) + ib.q * log1p(-ib.y)"
    lower = f"exp({front}) / ib.p * {_fraction_sql('ib.p', 'ib.q', 'ib.y')}"
    given = f"named_struct('a', CAST({a} AS DOUBLE), 'b', CAST({b} AS DOUBLE), 'x', CAST({x} AS DOUBLE))"
    turned = _bound(given, "ig", "named_struct('x', ig.x, 'flip', ig.x > (ig.a + 1) / (ig.a + ig.b + 2), 'a', ig.a, 'b', ig.b)")
    tail = _bound(
        turned, "iv", "named_struct('x', iv.x, 'flip', iv.flip, 'p', if(iv.flip, iv.b, iv.a), 'q', if(iv.flip, iv.a, iv.b), 'y', if(iv.flip, 1 - iv.x, iv.x))"
    )
    value = f"CASE WHEN ib.x <= 0 THEN 0D WHEN ib.x >= 1 THEN 1D ELSE {_bound(lower, 'il', 'if(ib.flip, 1 - il, il)')} END"
    return _bound(tail, "ib", value)


def log_gamma(x: str) -> Column:
    return F.expr(log_gamma_sql(x))


def incomplete_beta(a: str, b: str, x: str) -> Column:
    return F.expr(incomplete_beta_sql(a, b, x))


def f_cdf(x: str, d1: str, d2: str) -> Column:
    inner = incomplete_beta_sql("fc.d1 / 2", "fc.d2 / 2", "fc.d1 * fc.x / (fc.d1 * fc.x + fc.d2)")
    given = f"named_struct('x', CAST({x} AS DOUBLE), 'd1', CAST({d1} AS DOUBLE), 'd2', CAST({d2} AS DOUBLE))"
    return F.expr(_bound(given, "fc", f"if(fc.x <= 0, 0D, {inner})"))


def f_sf(x: str, d1: str, d2: str) -> Column:
    """The upper tail, exact where it is small; an infinite x has none."""
    inner = incomplete_beta_sql("fs.d2 / 2", "fs.d1 / 2", "fs.d2 / (fs.d1 * fs.x + fs.d2)")
    given = f"named_struct('x', CAST({x} AS DOUBLE), 'd1', CAST({d1} AS DOUBLE), 'd2', CAST({d2} AS DOUBLE))"
    return F.expr(_bound(given, "fs", f"CASE WHEN fs.x <= 0 THEN 1D WHEN fs.x = double('inf') THEN 0D ELSE {inner} END"))


def f_quantile(p: str, d1: str, d2: str) -> Column:
    """x with f_cdf(x) = p, for p between 0 and 1, by halving the bracket of y = d1 x / (d1 x + d2)."""
    given = f"named_struct('p', CAST({p} AS DOUBLE), 'd1', CAST({d1} AS DOUBLE), 'd2', CAST({d2} AS DOUBLE))"
    low = f"{incomplete_beta_sql('fq.d1 / 2', 'fq.d2 / 2', 'fm')} < fq.p"
    halved = _bound("(h.low + h.high) / 2", "fm", _bound(low, "fl", "named_struct('low', if(fl, fm, h.low), 'high', if(fl, h.high, fm))"))
    y = f"aggregate(sequence(1, {HALVINGS}), named_struct('low', 0D, 'high', 1D), (h, i) -> {halved}, h -> (h.low + h.high) / 2)"
    return F.expr(_bound(given, "fq", _bound(y, "fy", "fq.d2 * fy / (fq.d1 * (1 - fy))")))
