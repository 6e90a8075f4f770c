"""The numeric helpers against plain least squares, closed forms and simulation."""

import math

import numpy as np
import pytest

from lagwise.functions import statistics as st

rng = np.random.default_rng(7)


def residuals(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, float(e @ e)


def brute_granger(y, x, lags):
    n = len(y)
    rows = np.arange(lags, n)
    own = np.column_stack([np.ones(len(rows))] + [y[rows - k] for k in range(1, lags + 1)])
    both = np.column_stack([own] + [x[rows - k] for k in range(1, lags + 1)])
    _, small = residuals(own, y[rows])
    _, full = residuals(both, y[rows])
    freedom = len(rows) - 2 * lags - 1
    return (small - full) / lags / (full / freedom), freedom


def brute_unit_root(y):
    n = len(y)
    longest = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    steps = np.diff(y)

    def design(lags, start):
        rows = np.arange(start, len(steps))
        return np.column_stack([np.ones(len(rows)), y[rows]] + [steps[rows - k] for k in range(1, lags + 1)]), steps[rows]

    scores = []
    for lags in range(longest + 1):
        x, target = design(lags, longest)
        _, ssr = residuals(x, target)
        llf = -len(target) / 2 * (math.log(2 * math.pi) + math.log(ssr / len(target)) + 1)
        scores.append(-2 * llf + 2 * x.shape[1])
    best = int(np.argmin(scores))
    x, target = design(best, best)
    beta, ssr = residuals(x, target)
    cov = ssr / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return beta[1] / math.sqrt(cov[1, 1]), best


@pytest.mark.parametrize("kind", ["noise", "walk", "ar", "short"])
def test_unit_root_equals_refitting(kind):
    n = 40 if kind == "short" else 300
    e = rng.normal(size=n)
    y = {"noise": e + 50, "walk": np.cumsum(e), "short": e, "ar": e}[kind]
    if kind == "ar":
        for t in range(2, n):
            y[t] += 0.6 * y[t - 1] - 0.3 * y[t - 2]
    statistic, p, lags = st.unit_root_test(y)
    want, want_lags = brute_unit_root(y)
    assert lags == want_lags
    assert statistic == pytest.approx(want, rel=1e-7)
    assert (p < 0.05) == (kind != "walk")


def test_unit_root_reference_points():
    assert st.adf_p_value(-2.86154) == pytest.approx(0.05, abs=2e-4)
    assert st.adf_p_value(-3.43035) == pytest.approx(0.01, abs=2e-4)
    assert st.adf_p_value(5) == 1.0 and st.adf_p_value(-30) == 0.0


def test_unit_root_refuses_constant_and_tiny():
    assert st.unit_root_test(np.full(100, 3.0)) is None
    assert st.unit_root_test(np.array([1.0, 2.0])) is None


def test_f_tail_closed_form_and_known_value():
    for f, d2 in [(0.3, 10), (2.5, 90), (40.0, 7)]:
        assert float(st.f_tail(f, 2, d2)) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-10)
    assert float(st.f_tail(3.3258, 5, 10)) == pytest.approx(0.05, abs=1e-4)
    assert float(st.f_tail(0.0, 3, 9)) == pytest.approx(1.0)


def test_f_tail_by_simulation():
    draws = rng.f(5, 90, 200_000)
    assert float(st.f_tail(1.7, 5, 90)) == pytest.approx((draws >= 1.7).mean(), abs=0.004)


def test_lagged_sums_give_the_same_f_as_refitting():
    n, most = 220, 15
    x = rng.normal(size=n)
    y = rng.normal(size=n)
    y[3:] += 0.8 * x[:-3]
    y, x = y - y.mean(), x - x.mean()
    series = {"y": y, "x": x}
    products = {
        a + b: np.array([series[a][d:] @ series[b][: n - d] for d in range(most + 1)]) for a in "yx" for b in "yx"
    }
    for lags in (1, 2, 3, 7, 15):
        head = {c: series[c][:lags] for c in "yx"}
        tail = {c: series[c][-most:] for c in "yx"}
        moments, rows = st.lag_moments(products, head, tail, {c: series[c].sum() for c in "yx"}, n, lags)
        f, p = st.nested_f_test(moments, rows, lags)
        want, freedom = brute_granger(y, x, lags)
        assert f == pytest.approx(want, rel=1e-8)
        assert p == pytest.approx(float(st.f_tail(want, lags, freedom)), rel=1e-6, abs=1e-12)
        assert (p < 0.05) == (lags >= 3)


def test_ridge_and_least_squares():
    x = rng.normal(size=(80, 4)) * [1, 10, 0.1, 5] + 3
    y = x @ [1.0, -2.0, 30.0, 0.5] + rng.normal(size=80) + 7
    full = np.column_stack([np.ones(80), y, x])
    moments = full.T @ full
    ols, _ = residuals(np.column_stack([np.ones(80), x]), y)
    assert st.ridge_solve(moments) == pytest.approx(ols, rel=1e-8)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    assert st.ridge_solve(moments, 1.0)[1:] == pytest.approx(beta, rel=1e-9)


def test_least_squares_with_a_constant_column():
    x = np.column_stack([rng.normal(size=50), np.full(50, 4.0)])
    y = 2 * x[:, 0] + 5
    full = np.column_stack([np.ones(50), y, x])
    b = st.ridge_solve(full.T @ full)
    assert b[0] + x @ b[1:] == pytest.approx(y, abs=1e-8)
