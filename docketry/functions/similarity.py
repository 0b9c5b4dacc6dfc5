"""Text similarities that SQL can't express, as Arrow-batched pandas UDFs over pairs of short texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pairs(a: pd.Series, b: pd.Series, measure) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(measure(x, y)) for x, y in zip(a, b)], dtype="float64")


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity 2M/T without the heuristic for popular characters."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with windows of the longer of its length; zero if either is empty."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer per row."""
    seen: dict[str, int] = {}
    for i, ch in enumerate(a):
        seen[ch] = seen.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = row & seen.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def common_run(a: str, b: str) -> int:
    """Length of the longest common substring."""
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """MAT-02; null where either text is."""
    return _pairs(a, b, ratio)


@F.pandas_udf(T.DoubleType())
def windowed_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """MAT-03."""
    return _pairs(a, b, partial_ratio)


@F.pandas_udf(T.DoubleType())
def lcs_coverage(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Longest common subsequence over the length of ``expected``; zero if that is empty (MAT-04)."""
    return _pairs(expected, actual, lambda e, a: lcs_length(e, a) / len(e) if e else 0.0)


@F.pandas_udf(T.DoubleType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """MAT-06."""
    return _pairs(a, b, common_run)
