"""Scalar column functions: calendar, normal distribution, option formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a column; null stays null."""
    if lo is not None:
        x = F.when(x < lo, lo).otherwise(x)
    return F.when(x > hi, hi).otherwise(x) if hi is not None else x


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def zero_if_missing(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def third_friday(d: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "Fri"), 14)


def days_to_monthly_expiry(d: Column) -> Column:
    """Calendar days to this month's third Friday, or the next month's once it has passed."""
    this = third_friday(d)
    return F.datediff(F.when(d <= this, this).otherwise(third_friday(F.add_months(F.trunc(d, "MM"), 1))), d)


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in [a, b)."""

    def upto(d: Column) -> Column:  # weekdays since Monday 1970-01-05
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return upto(b) - upto(a)


def quarter_end_flag(d: Column, days: int = 5) -> Column:
    near = business_days(d, F.last_day(d)) <= days
    return F.when(F.month(d).isin(3, 6, 9, 12) & near, 1).otherwise(0)


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d), F.lit("Q"), F.quarter(d))


#: Fixed values of the rational approximation of erf (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function; absolute error below 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + ERF_P * z)
    poly = ERF_A[4]
    for a in reversed(ERF_A[:4]):
        poly = a + t * poly
    tail = 0.5 * t * poly * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def chi2_1_tail(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return 2 * (1 - normal_cdf(F.sqrt(x)))


#: Fixed values of Acklam's rational approximation of the normal quantile: centre (numerator, denominator), tails (likewise), and where the tails begin.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_TAIL = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution; relative error below 1.2e-9. Null outside (0, 1)."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(PPF_C, t) / _polynomial(PPF_D, t)
    inside = F.when(p < PPF_TAIL, tail).when(p > 1 - PPF_TAIL, -tail).otherwise(q * _polynomial(PPF_A, r) / _polynomial(PPF_B, r))
    return F.when((p > 0) & (p < 1), inside)


def normal_quantile_sql(p: str) -> str:
    """The same as SQL."""

    def polynomial(coefficients: tuple[float, ...], x: str) -> str:
        out = f"{coefficients[0]!r}"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    t, r = f"SQRT(-2 * LN(LEAST({p}, 1 - ({p}))))", f"(({p}) - 0.5) * (({p}) - 0.5)"
    tail = f"{polynomial(PPF_C, t)} / {polynomial(PPF_D, t)}"
    return f"(CASE WHEN ({p}) < {PPF_TAIL} THEN {tail} WHEN ({p}) > 1 - {PPF_TAIL} THEN -({tail}) ELSE (({p}) - 0.5) * {polynomial(PPF_A, f'({r})')} / {polynomial(PPF_B, f'({r})')} END)"


def svi_variance(k: Column, a: Column, b: Column, rho: Column, m: Column, sigma: Column) -> Column:
    """Total variance of the SVI smile at log-moneyness k."""
    return a + b * (rho * (k - m) + F.sqrt((k - m) * (k - m) + sigma * sigma))


def strike_ratio_of_delta(quantile: float, vol: Column, tau: Column) -> Column:
    """Strike over forward at which a Black-Scholes call has delta N(quantile)."""
    return F.exp(0.5 * vol * vol * tau - F.lit(quantile) * vol * F.sqrt(tau))


def correlation(x: str, y: str) -> Column:
    """Correlation over the rows that have both values; null if either doesn't vary (``corr`` raises there in ANSI mode)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
