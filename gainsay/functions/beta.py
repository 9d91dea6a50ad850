"""Beta-distribution statistics as SQL expressions (no joins, no UDFs, inside codegen)."""

from __future__ import annotations

import math

# Fixed values (must equal the published behaviour).
EULER_GAMMA = 0.5772156649015329
TETRAGAMMA_AT_ONE = -2.404114
TWO_ZETA_3 = 2.404113806319188
DIGAMMA_LOG_FROM = 1000
TRIGAMMA_INVERSE_FROM = 500
TETRAGAMMA_INVERSE_FROM = 200
SOUND_DISTANCE = 2.0
BIAS_MEAN = 0.8

# Below this argument the finite sum is listed, above it the asymptotic series is exact to ~1e-15.
_SERIES_FROM = 16


def _finite_sums(start: float, term) -> str:
    values, acc = [start], start
    for k in range(1, _SERIES_FROM - 1):
        acc += term(k)
        values.append(acc)
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _piecewise(n: str, limit: int, beyond: str, series: str, sums: str) -> str:
    return (f"CASE WHEN {n} >= {limit} THEN {beyond} WHEN {n} >= {_SERIES_FROM} THEN {series} "
            f"ELSE element_at({sums}, CAST({n} AS INT)) END")


def digamma_sql(n: str) -> str:
    """psi(n) for a positive integer; ``ln n`` from 1000 on."""
    x = f"CAST({n} AS DOUBLE)"
    q = f"(1D / ({x} * {x}))"
    series = f"ln({x}) - 0.5D / {x} - {q} * (1D/12 - {q} * (1D/120 - {q} * (1D/252 - {q} * (1D/240))))"
    return _piecewise(n, DIGAMMA_LOG_FROM, f"ln({x})", series, _finite_sums(-EULER_GAMMA, lambda k: 1.0 / k))


def trigamma_sql(n: str) -> str:
    """psi'(n) for a positive integer; ``1/n`` from 500 on."""
    r = f"(1D / CAST({n} AS DOUBLE))"
    q = f"({r} * {r})"
    series = f"{r} + {q} * 0.5D + {r} * {q} * (1D/6 - {q} * (1D/30 - {q} * (1D/42 - {q} * (1D/30))))"
    return _piecewise(n, TRIGAMMA_INVERSE_FROM, r, series,
                      _finite_sums(math.pi ** 2 / 6, lambda k: -1.0 / (k * k)))


def tetragamma_sql(n: str) -> str:
    """psi''(n) for a positive integer; ``1/n**2`` (note the sign) from 200 on."""
    r = f"(1D / CAST({n} AS DOUBLE))"
    q = f"({r} * {r})"
    tail = f"({q} + {q} * {r} + {q} * {q} * (0.5D - {q} * (1D/6 - {q} * (1D/6 - {q} * 0.3D))))"
    series = f"{TETRAGAMMA_AT_ONE + TWO_ZETA_3!r}D - {tail}"
    return _piecewise(n, TETRAGAMMA_INVERSE_FROM, q, series,
                      _finite_sums(TETRAGAMMA_AT_ONE, lambda k: 2.0 / k ** 3))


def mean_sql(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST({a} + {b} AS DOUBLE))"


def mean_log_sql(a: str, b: str) -> str:
    """E[ln p] under Beta(a, b)."""
    return f"({digamma_sql(a)} - {digamma_sql(f'({a} + {b})')})"


def spread_log_sql(a: str, b: str) -> str:
    """Var[ln p] under Beta(a, b) (used without a square root)."""
    return f"({trigamma_sql(a)} - {trigamma_sql(f'({a} + {b})')})"


def gradient_sql(a: str, b: str) -> str:
    total = f"CAST({a} + {b} AS DOUBLE)"
    return f"(CAST({b} AS DOUBLE) / (CAST({a} AS DOUBLE) * {total} * {total}))"


def beta_columns(a: str = "a", b: str = "b", prefix: str = "") -> list[str]:
    """The four statistics of Beta(a, b), ready for ``selectExpr``."""
    return [f"{mean_sql(a, b)} AS {prefix}mean", f"{mean_log_sql(a, b)} AS {prefix}mean_log",
            f"{spread_log_sql(a, b)} AS {prefix}spread_log", f"{gradient_sql(a, b)} AS {prefix}grad"]


def distance_sql(lower_log: str, lower_spread: str, upper_log: str, upper_spread: str, upper_mean: str) -> str:
    """How clearly the upper distribution lies below the lower one, in combined deviations."""
    spread = f"sqrt({lower_spread} * {lower_spread} + {upper_spread} * {upper_spread})"
    damp = f"CASE WHEN {upper_mean} > {BIAS_MEAN}D THEN exp({-(1.0 - BIAS_MEAN)!r}D / (1D - {upper_mean})) ELSE 1D END"
    return f"(({lower_log} - {upper_log}) / {spread} * {damp})"


def norm_dist_sql(lower_a: str, lower_b: str, upper_a: str, upper_b: str) -> str:
    """``distance_sql`` of Beta(lower_a, lower_b) and Beta(upper_a, upper_b)."""
    return distance_sql(mean_log_sql(lower_a, lower_b), spread_log_sql(lower_a, lower_b),
                        mean_log_sql(upper_a, upper_b), spread_log_sql(upper_a, upper_b),
                        mean_sql(upper_a, upper_b))
