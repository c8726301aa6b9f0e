"""Mixture targets that the shares as they are do not meet."""

import math

import pytest

from sluice.llm import mixing

COUNTS = {"a": 1000, "b": 100, "c": 10, "none": 0}


def test_entropy_below_that_of_the_shares():
    for target in (0.2, 0.01):
        exponent = mixing.exponent_for(COUNTS, 1110, None, target)
        assert exponent > 1 and math.isclose(mixing.entropy(mixing.weights(COUNTS, exponent)), target, rel_tol=1e-6)


def test_targets_out_of_reach_are_errors():
    with pytest.raises(ValueError, match="repeats"):
        mixing.exponent_for(COUNTS, 5 * 1110, 4.0)
    with pytest.raises(ValueError, match="entropy"):
        mixing.exponent_for({"a": 5, "b": 5}, 10, None, 0.5)
    assert mixing.exponent_for(COUNTS, 4 * 1110, 4.0) == pytest.approx(1.0)
