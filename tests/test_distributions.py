"""Published and hand-computed values of the distribution functions."""

from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from assay.functions import distributions as D
from assay.operators.posthoc import adjust
from assay.operators.power import analyse


@pytest.mark.parametrize(
    ("found", "wanted"),
    [
        (lambda: D.t_two_sided(-2.0, 8), 0.0805162380),
        (lambda: D.t_two_sided(-2.8878943875, 9.6645412575), 0.0167141233),
        (lambda: D.f_sf(8, 2, 12), 0.0061963978),
        (lambda: D.chi2_sf(8.1159420290, 2), 0.0172840527),
        (lambda: D.chi2_sf(1.0971428571, 1), 0.2948939838),
        (lambda: D.chi2_ppf(0.975, 2), 7.3777589082),
        (lambda: D.chi2_ppf(0.975, 3), 9.3484036045),
        (lambda: D.chi2_ppf(0.999, 2), 13.8155105580),
        (lambda: 2 * D.norm_sf(2.6832815730), 0.0072903581),
        (lambda: D.hypergeometric_two_sided(8, 2, 1, 5), 0.0349650350),
        (lambda: D.mann_whitney_p(4.5, 5, 5, 18), 0.1138462980),
        (lambda: D.ks_p(0.2, 5, 5), 1.0),
        (lambda: D.studentized_range_sf(2 / math.sqrt(0.5), 3, 12), 0.1545799684),
        (lambda: D.studentized_range_sf(4 / math.sqrt(0.5), 3, 12), 0.0046340806),
        (lambda: D.studentized_range_ppf(0.95, 3, 12) * math.sqrt(0.5), 2.6678636567),
        (lambda: float(D.digamma(0.3)), -3.5025242222),
        (lambda: float(D.trigamma(0.3)), 12.2453645461),
    ],
)
def test_pinned_values(found, wanted):
    assert found() == pytest.approx(wanted, abs=2e-8)


def test_mann_whitney_exact_counts_every_arrangement():
    # U = 0 of 3 against 3: two of 20 arrangements are as extreme
    assert D.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1)


def test_ks_exact_small():
    # fully separated groups of 3: two of 20 paths
    assert D.ks_p(1.0, 3, 3) == pytest.approx(0.1)


def test_shapiro_published_example():
    w, p = D.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    assert D.shapiro_wilk([1.0, 2.0]) is None and D.shapiro_wilk([3.0] * 9) is None


@pytest.mark.parametrize(
    ("inputs", "wanted"),
    [
        ({"test": "two_sample_t", "effect_size": 0.5, "power": 0.8}, 63.7656),
        ({"test": "two_sample_t", "n": 64, "power": 0.8}, 0.4991),
        ({"test": "two_sample_t", "effect_size": 0.5, "n": 64}, 0.8015),
        ({"test": "two_proportion_z", "p1": 0.10, "p2": 0.12, "power": 0.8}, 3834.5957),
        ({"test": "anova_oneway", "effect_size": 0.25, "power": 0.8, "k_groups": 4}, 178.3971),
        ({"test": "one_sample_t", "effect_size": 0.5, "power": 0.8}, 33.3671),
        ({"test": "one_sample_t", "effect_size": 0.5, "power": 0.8, "alternative": "larger"}, 26.1375),
    ],
)
def test_power(inputs, wanted):
    assert analyse(**inputs)["value"] == pytest.approx(wanted, abs=1e-4)


@pytest.mark.parametrize(
    ("inputs", "error"),
    [
        ({"test": "two_sample_t", "effect_size": 0.5}, "invalid_inputs"),
        ({"test": "nope", "effect_size": 0.5, "n": 3}, "invalid_inputs"),
        ({"test": "two_proportion_z", "p1": 0.1, "n": 30}, "missing_proportions"),
        ({"test": "anova_oneway", "effect_size": 0.5, "n": 30}, "missing_k_groups"),
    ],
)
def test_power_errors(inputs, error):
    with pytest.raises(ValueError, match=error):
        analyse(**inputs)


def test_adjustments():
    assert adjust([0.01, 0.04, 0.03], "bonferroni") == pytest.approx([0.03, 0.12, 0.09])
    assert adjust([0.01, 0.01, 0.01], "sidak")[0] == pytest.approx(0.029701)
    # Benjamini and Hochberg (1995), table 1: four rejections
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    found = adjust(p, "bh")
    assert found[:4] == pytest.approx([0.0015, 0.003, 0.0095, 0.035625]) and sum(x <= 0.05 for x in found) == 4
    assert adjust([], "bh") == []


@given(st.lists(st.floats(0, 1), min_size=1, max_size=30), st.sampled_from(["bonferroni", "sidak", "holm", "bh", "by"]))
def test_adjusted_values_stay_probabilities_and_in_order(p, method):
    found = adjust(p, method)
    assert all(0 <= x <= 1 + 1e-12 for x in found)
    order = sorted(range(len(p)), key=p.__getitem__)
    assert all(found[a] <= found[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))


@given(st.floats(0.01, 0.99), st.floats(1, 60))
def test_quantiles_invert_tails(p, df):
    assert D.t_sf(D.t_ppf(p, df), df) == pytest.approx(1 - p, abs=1e-8)
    assert D.chi2_sf(D.chi2_ppf(p, df), df) == pytest.approx(1 - p, abs=1e-8)
