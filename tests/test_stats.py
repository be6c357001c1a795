"""Student-t probabilities against textbook values."""

import pytest

from quillfen.functions import stats


@pytest.mark.parametrize(
    "t, df, p",
    [(2.228, 10, 0.05), (1.96, 10**7, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05), (3.169, 10, 0.01)],
)
def test_two_sided_p(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)


def test_critical_value_inverts_p():
    assert stats.t_critical(0.05, 10) == pytest.approx(2.2281, abs=1e-3)
    assert stats.t_two_sided(stats.t_critical(0.03, 17), 17) == pytest.approx(0.03, abs=1e-9)


def test_power_known_design():
    # d = 0.5 needs about 64 per group for a power of 0.8 at the 5 % level.
    assert stats.two_sample_power(0.5, 64, 64) == pytest.approx(0.8015, abs=2e-3)
    assert stats.two_sample_power(0.0, 50, 50) == pytest.approx(0.05, abs=1e-4)
    assert stats.two_sample_power(0.8, 26, 26) == pytest.approx(0.807, abs=3e-3)


def test_correlation_p_value_edges():
    assert stats.correlation_p_value(None, 10) == 1.0
    assert stats.correlation_p_value(1.0, 10) == 0.0
    assert stats.correlation_p_value(0.5, 2) == 1.0
    assert stats.correlation_p_value(0.632, 10) == pytest.approx(0.05, abs=1e-3)
