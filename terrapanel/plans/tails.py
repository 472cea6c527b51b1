"""SQL for tail areas, quantiles and corrections, by series: independent of ``functions.distributions``."""

from __future__ import annotations


def _beta_series(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function by its series in x, for x not beyond (a + 1) / (a + b + 2)."""
    term = f"exp(lgamma({a} + {b} + j) - lgamma({a} + {b}) - lgamma({a} + 1 + j) + lgamma({a} + 1) + j * ln({x}))"
    front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    return f"{front} * list_sum(list_transform(range(0, 1500), lambda j: {term}))"


def beta_sql(a: str, b: str, x: str) -> str:
    near = f"{x} <= ({a} + 1) / ({a} + {b} + 2)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {near} THEN {_beta_series(a, b, x)} ELSE 1 - {_beta_series(b, a, f'(1 - {x})')} END"


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p value of Student's t."""
    return beta_sql(f"({df} / 2.0)", "0.5", f"({df} / ({df} + {t} * {t}))")


def normal_p_sql(z: str) -> str:
    """Two-sided p value of a normal z: 1 - exp(-x^2) sum x^(2j+1) / gamma(j + 3/2), x = |z| / sqrt 2."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp((2 * j + 1) * ln({x}) - lgamma(j + 1.5) - {x} * {x})"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 12 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 400), lambda j: {term}))) END"


def sign_p_sql(k: str, n: str) -> str:
    term = f"exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2))"
    return f"least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({k}, {n} - {k}) AS BIGINT) + 1), lambda j: {term})))"


def critical_sql(upto: int = 80) -> str:
    """CTEs of a WITH RECURSIVE up to crit(df, c): upper 2.5 % points of Student's t by bisection of the series."""
    step = f"SELECT *, {t_p_sql('mid', 'df')} AS p FROM (SELECT *, (low + high) / 2 AS mid FROM bisected WHERE i < 56)"
    return (
        f"bisected(df, low, high, i) AS (SELECT df, 0.0::DOUBLE, 16.0::DOUBLE, 0 FROM range(1, {upto + 1}) AS s(df) UNION ALL "
        f"SELECT df, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END, i + 1 FROM ({step})), crit AS (SELECT df, (low + high) / 2 AS c FROM bisected WHERE i = 56)"
    )


def ranked_sql(p: str, group: str = "") -> str:
    """Columns i, m and h of rows with a p value: rank, number of tests and their harmonic sum."""
    part = f"PARTITION BY {group}" if group else ""
    return f"row_number() OVER ({part} ORDER BY {p}) AS i, count(*) OVER ({part}) AS m, list_sum(list_transform(range(1, count(*) OVER ({part}) + 1), lambda j: 1.0 / j)) AS h"


def q_sql(p: str, group: str = "", factor: str = "m") -> str:
    """q value from the columns of ranked_sql; ``factor`` m: Benjamini-Hochberg, m * h: Benjamini-Yekutieli."""
    part = f"PARTITION BY {group}" if group else ""
    return f"least(1.0, min({p} * {factor} / i) OVER ({part} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
