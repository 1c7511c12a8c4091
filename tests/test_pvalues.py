"""p-values against published report values, brute force and known constants."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from siltmark.functions import pvalues as P


@pytest.mark.parametrize("d, n, m, expected", [
    (0.069, 750, 600, 0.079961),
    (0.05824, 750, 1100, 0.092597),
    (0.42303, 750, 1100, 0.0),
])
def test_ks_golden(d, n, m, expected):
    assert round(P.ks_two_sided(d, n, m), 6) == expected


@pytest.mark.parametrize("x, dof, expected", [
    (1.6446, 5, 0.895807), (0.4884, 3, 0.921432), (19.4824, 3, 0.000217),
    (34.0279, 5, 0.000002), (40.511, 3, 0.0),
])
def test_chi2_golden(x, dof, expected):
    # The published statistic has four decimals; test_statistics starts from counts.
    assert P.chi2_survival(x, dof) == pytest.approx(expected, abs=1e-5)


def test_chi2_known_quantiles():
    assert P.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert P.chi2_survival(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert P.chi2_survival(0.0, 4) == 1.0
    assert P.chi2_survival(5.0, 0) == 1.0
    # Large degrees of freedom: series and normal approximation meet.
    series = P.chi2_survival(100_300.0, 100_000)
    approx = P.chi2_survival(100_301.0, 100_001)
    assert series == pytest.approx(approx, abs=1e-5)


@pytest.mark.parametrize("n, m", [(3, 3), (4, 3), (5, 2), (6, 4), (5, 5)])
def test_ks_exact_equals_enumeration(n, m):
    """All orderings of two samples without ties are equally likely under the null."""
    values = []
    for chosen in itertools.combinations(range(n + m), n):
        a = b = 0
        worst = 0.0
        for i in range(n + m):
            a, b = (a + 1, b) if i in chosen else (a, b + 1)
            worst = max(worst, abs(a / n - b / m))
        values.append(worst)
    for d in sorted(set(values)):
        p = sum(v >= d - 1e-12 for v in values) / len(values)
        assert P.ks_exact(d, n, m) == pytest.approx(p, abs=1e-12)


def test_ks_exact_does_not_underflow_on_large_samples():
    d = 0.02
    limit = P.kolmogorov_sf(d * math.sqrt(5000))
    assert P.ks_exact(d, 10_000, 10_000) == pytest.approx(limit, abs=0.01)


def test_one_sample_law():
    # Published value of Marsaglia, Tsang and Wang: P(D_10 < 0.274) = 0.6284796...
    assert P._one_sample_matrix(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-9)


def test_effective_law_is_continuous_between_methods():
    n = 1000
    for z in (0.6, 0.9, 1.36):
        d = z / math.sqrt(n)
        exact = 1 - P._one_sample_matrix(d, n)
        root = math.sqrt(n)
        corrected = P.kolmogorov_sf(z + 1 / (6 * root) + (z - 1) / (4 * n))
        assert corrected == pytest.approx(exact, abs=5e-5)


def test_ks_edges():
    assert P.ks_two_sided(0.0, 10, 10) == 1.0
    assert P.ks_two_sided(0.5, 0, 10) == 1.0
    assert P.ks_two_sided(1.0, 50, 50) < 1e-20
    assert np.isfinite(P.ks_two_sided(0.3, 20_000, 20))


@pytest.mark.parametrize("dof", [99_999, P.FINITE_DOF])
def test_chi2_approximation_against_the_finite_sum(dof):
    for z in (-6, -4, -2, -1, 0, 1, 2, 3, 4, 5, 6):
        x = dof + z * math.sqrt(2 * dof)
        exact, near = P.chi2_survival(x, dof), P.wilson_hilferty(x, dof)
        assert abs(near - exact) < 1e-7 and abs(near - exact) < exact * (1e-6 if z <= 2 else 2.5e-4)


def test_chi2_is_continuous_where_the_method_changes():
    for z in (-3, 0, 3):
        x = P.FINITE_DOF + z * math.sqrt(2 * P.FINITE_DOF)
        assert P.chi2_survival(x, P.FINITE_DOF) < P.chi2_survival(x, P.FINITE_DOF + 1) < P.chi2_survival(x, P.FINITE_DOF + 2)
