from itertools import product
from math import exp

import pytest

from genomespark.llm import sentences as S


def brute(odds, alone):
    """Marginals summed over all 2^n ways to set the marks."""
    yes, no = [0.0] * len(odds), [0.0] * len(odds)
    for marks in product([False, True], repeat=len(odds)):
        w = 1.0
        for i, m in enumerate(marks):
            p = 1 / (1 + exp(-odds[i]))
            w *= p if m else 1 - p
            if i and m and marks[i - 1] and alone[i]:
                w *= S.ALONE
        for i, m in enumerate(marks):
            (yes if m else no)[i] += w
    return [a > b for a, b in zip(yes, no)]


@pytest.mark.parametrize("odds, alone", [((4.5, 2.5), (False, True)), ((4.5, 4.5, 4.5), (False, True, True)), ((4.5, 2.5, 3.0, -4.0), (True, True, False, True)), ((3.0, -3.0), (False, False)), ((2.5, 0.4), (True, False))])
def test_sure_chains_with_short_parts(odds, alone):
    assert S.posteriors(list(odds), list(alone)) == brute(odds, alone)


def test_the_second_mark_around_a_short_part_is_dropped():
    assert S.posteriors([4.5, 2.5], [False, True]) == [True, False]
    assert S.posteriors([4.5, 4.5, 4.5], [False, True, True]) == [True, False, True]
