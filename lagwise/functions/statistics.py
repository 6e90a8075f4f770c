"""Small numeric helpers that run inside pandas UDFs, on arrays of group summaries."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) response surface of the unit-root test with a constant, one
# series. Below the switch point the small-p polynomial applies, above it the large-p one;
# coefficients are in ascending powers of the statistic.
ADF_LOWEST, ADF_SWITCH, ADF_HIGHEST = -18.83, -1.61, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(statistic: float) -> float:
    if statistic > ADF_HIGHEST:
        return 1.0
    if statistic < ADF_LOWEST:
        return 0.0
    powers = ADF_SMALL_P if statistic <= ADF_SWITCH else ADF_LARGE_P
    z = sum(c * statistic**i for i, c in enumerate(powers))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method.

    It needs in the order of the root of the larger parameter steps; that it has not come to rest is an error.
    """
    rounds = 400 + int(20 * math.sqrt(max(a.max(initial=0), b.max(initial=0))))
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, rounds):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value *= c * d
        if np.all(np.abs(c * d - 1.0) < 1e-14):
            return value
    raise ArithmeticError("the continued fraction of the incomplete beta function did not converge")


def _log_gamma(v: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(v)


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x >= (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x))
    out[inside] = np.where(swap, 1.0 - left / b, left / a)
    return out


def f_tail(statistic, df1, df2) -> np.ndarray:
    """P(F >= statistic) with df1 and df2 degrees of freedom."""
    f = np.maximum(np.asarray(statistic, dtype=float), 0.0)
    return beta_cdf(np.asarray(df2) / 2.0, np.asarray(df1) / 2.0, df2 / (df2 + df1 * f))


def residual_path(gram: np.ndarray, target: np.ndarray, total: float) -> np.ndarray | None:
    """Residual sums of squares as columns enter one after another.

    `gram` is X'X, `target` X'y and `total` y'y. One Cholesky factor serves every leading
    sub-model. None when the columns are linearly dependent.
    """
    scale = np.sqrt(np.diag(gram))
    if not np.all(scale > 0):
        return None
    unit = gram / np.outer(scale, scale)
    try:
        factor = np.linalg.cholesky(unit)
    except np.linalg.LinAlgError:
        return None
    if np.min(np.diag(factor)) < 1e-7:
        return None
    z = np.linalg.solve(factor, target / scale)
    return total - np.concatenate([[0.0], np.cumsum(z**2)])


def unit_root_test(values: np.ndarray, lags: int | None = None) -> tuple[float, float, int] | None:
    """Augmented Dickey–Fuller test with a constant, lag length as given or by AIC: (statistic, p, lags).

    Candidate lag lengths are compared on the rows the longest one leaves; the chosen one is
    then fitted on all the rows it has. None when the test cannot be carried out.
    """
    y = np.asarray(values, dtype=float)
    y = y[~np.isnan(y)]
    n = len(y)
    if n < 4 or y.min() == y.max():
        return None
    longest = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
    if longest < 0:
        return None
    # Centre and scale: the statistic does not change, the arithmetic is safer.
    y = (y - y.mean()) / y.std()
    steps = np.diff(y)

    def design(lags: int):
        rows = np.arange(lags, len(steps))
        columns = [np.ones(len(rows)), y[rows]] + [steps[rows - k] for k in range(1, lags + 1)]
        return np.column_stack(columns), steps[rows]

    best = lags
    if lags is None:
        x, target = design(longest)
        path = residual_path(x.T @ x, x.T @ target, float(target @ target))
        if path is None or len(target) <= x.shape[1] or path[-1] <= 0:
            return None
        used = np.arange(2, longest + 3)
        aic = len(target) * np.log(path[2:] / len(target)) + 2.0 * used
        best = int(np.argmin(aic))
    x, target = design(best)
    try:
        inverse = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ (x.T @ target)
    freedom = len(target) - x.shape[1]
    if freedom <= 0:
        return None
    residual = target - x @ beta
    error = math.sqrt(float(residual @ residual) / freedom * inverse[1, 1])
    if not error > 0:
        return None
    statistic = float(beta[1] / error)
    return statistic, adf_p_value(statistic), best


def lag_moments(products: dict[str, np.ndarray], head: dict[str, np.ndarray], tail: dict[str, np.ndarray],
                sums: dict[str, float], n: int, lags: int) -> tuple[np.ndarray, int]:
    """Moment matrix of (1, y, y lags, x lags) over rows `lags`..n-1 of a series.

    `products["ab"][d]` is the sum of a[t] * b[t-d] over all rows that have both. Shifting both
    factors by the same lag leaves out the first and the last products, which are known from
    the first and last values of the series.
    """
    def corrected(a: str, b: str, i: int, j: int) -> float:
        if i > j:
            a, b, i, j = b, a, j, i
        d = j - i
        first = head[a][d:lags - i] @ head[b][: lags - j] if lags > j else 0.0
        last = 0.0
        if i:
            ends_a = tail[a][len(tail[a]) - i:]
            ends_b = tail[b][len(tail[b]) - j: len(tail[b]) - d]
            last = ends_a @ ends_b
        return products[a + b][d] - first - last

    def total(a: str, i: int) -> float:
        last = tail[a][len(tail[a]) - i:].sum() if i else 0.0
        return sums[a] - head[a][: lags - i].sum() - last

    names = [("y", 0)] + [("y", k) for k in range(1, lags + 1)] + [("x", k) for k in range(1, lags + 1)]
    size = len(names) + 1
    moments = np.empty((size, size))
    rows = n - lags
    moments[0, 0] = rows
    for p, (a, i) in enumerate(names, start=1):
        moments[0, p] = moments[p, 0] = total(a, i)
        for q, (b, j) in enumerate(names[:p], start=1):
            moments[p, q] = moments[q, p] = corrected(a, b, i, j)
    return moments, rows


def nested_f_test(moments: np.ndarray, rows: int, lags: int) -> tuple[float, float] | None:
    """(F, p) of dropping the x lags from y ~ 1 + y lags + x lags; None when singular."""
    order = [0] + list(range(2, 2 * lags + 2))
    gram = moments[np.ix_(order, order)]
    path = residual_path(gram, moments[order, 1], moments[1, 1])
    freedom = rows - 2 * lags - 1
    if path is None or freedom <= 0 or not path[-1] > 1e-12 * max(moments[1, 1], 1e-300):
        return None
    restricted, full = path[lags + 1], path[-1]
    statistic = (restricted - full) / lags / (full / freedom)
    return float(statistic), float(f_tail(statistic, lags, freedom))


def ridge_solve(moments: np.ndarray, alpha: float = 0.0) -> np.ndarray | None:
    """Intercept and coefficients from the moment matrix of (1, y, columns).

    The penalty falls on the coefficients of the centred columns, not on the intercept; with
    `alpha` 0 this is ordinary least squares, of minimum length when columns are dependent.
    """
    n = moments[0, 0]
    if not n > 0:
        return None
    means = moments[0, 1:] / n
    centred = moments[1:, 1:] - n * np.outer(means, means)
    gram, target = centred[1:, 1:], centred[1:, 0]
    if alpha > 0:
        beta = np.linalg.solve(gram + alpha * np.eye(len(gram)), target)
    else:
        scale = np.sqrt(np.clip(np.diag(gram), 0.0, None))
        flat = scale <= 1e-9 * np.sqrt(np.clip(np.diag(moments)[2:], 0.0, None))
        scale = np.where(flat, 1.0, scale)
        unit = np.where(np.outer(~flat, ~flat), gram / np.outer(scale, scale), 0.0)
        beta = np.linalg.pinv(unit, rcond=1e-12, hermitian=True) @ np.where(flat, 0.0, target / scale) / scale
    return np.concatenate([[means[0] - means[1:] @ beta], beta])
