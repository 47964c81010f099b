"""Exact tests of large counts against whole numbers."""

from math import comb

import pandas as pd
import pytest

from tidemill.functions import stats


def fisher(a, b, c, d):
    rows, column, total = a + b, a + c, a + b + c + d
    every = [comb(rows, x) * comb(total - rows, column - x) for x in range(max(0, column - (total - rows)), min(rows, column) + 1)]
    seen = comb(rows, a) * comb(total - rows, column - a)
    return sum(w for w in every if w * 10**9 <= seen * (10**9 + 1)) / comb(total, column)


@pytest.mark.parametrize("table", [(3, 1, 1, 3), (0, 0, 0, 0), (0, 5, 7, 0), (900, 800, 850, 1000), (1500, 1400, 1300, 1301), (40, 3000, 2000, 10)])
def test_fisher(table):
    found = stats.fisher.func(*[pd.Series([x]) for x in table])[0]
    assert found == pytest.approx(fisher(*table), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("pair", [(0, 0), (5, 0), (1000, 1100), (3000, 2500)])
def test_mcnemar(pair):
    n = sum(pair)
    exact = min(1.0, 2 * sum(comb(n, i) for i in range(min(pair) + 1)) / 2**n)
    assert stats.mcnemar.func(*[pd.Series([x]) for x in pair])[0] == pytest.approx(exact, rel=1e-9)


def test_counts_of_a_large_corpus():
    assert 0 < stats.fisher.func(*[pd.Series([x]) for x in (10_000_000, 10_004_000, 20_000_000, 20_000_000)])[0] < 1
    assert stats.mcnemar.func(pd.Series([30_000_000, None]), pd.Series([30_000_000, 1.0])).isna().tolist() == [False, True]
