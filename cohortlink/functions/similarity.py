"""Weighted similarity of two names, between 0 and 1.

The base is the share of letters two strings have in common in order: ``2 * LCS / (len + len)``.
Strings of like length may instead be compared word by word at 0.95; where one string is at least
1.5 times as long as the other, the best window of the longer one counts at 0.9 (0.6 beyond 8
times), and its words at 0.95 of that.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITESPACE

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of the word-wise and the window comparison, and the length ratios they start at.
WORDS = 0.95
WINDOW = 0.9
FAR_WINDOW = 0.6
WINDOW_FROM = 1.5
FAR_FROM = 8.0

# One blank of any kind, as str.split() knows them, for regular expressions of the JVM.
BLANK = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]"

_NATIVE_LIMIT = 61  # letters whose matches fit the bits of one long value


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    return masks


def _common(masks: dict[str, int], size: int, b: str) -> int:
    full = (1 << size) - 1
    state = full
    for letter in b:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _ratio(a: str, b: str) -> float:
    return 2 * _common(_masks(a), len(a), b) / (len(a) + len(b)) if a and b else 0.0


def _best_window(a: str, b: str) -> float:
    """Best window of the longer string; of two equally long ones, of either."""
    if len(a) == len(b):
        return max(_slide(a, b), _slide(b, a))
    return _slide(*sorted((a, b), key=len))


def _slide(short: str, long: str) -> float:
    size = len(short)
    if not size:
        return 0.0
    masks = _masks(short)
    starts = range(1 - size, len(long))
    windows = {long[max(i, 0):i + size] for i in starts}
    return max(2 * _common(masks, size, w) / (size + len(w)) for w in windows)


def _by_words(a: str, b: str) -> float:
    """Words sorted, or split into those shared and those not, whichever is more alike."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (only_left and only_right):
        return 1.0
    best = _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    lead = len(shared) + 1 if shared else 0
    n_left, n_right = lead + len(only_left), lead + len(only_right)
    apart = len(only_left) + len(only_right) - 2 * _common(_masks(only_left), len(only_left), only_right)
    best = max(best, 1 - apart / (n_left + n_right))
    if shared:
        n = len(shared)
        best = max(best, 2 * n / (n + n_left), 2 * n / (n + n_right))
    return best


def _window_by_words(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if left & right:
        return 1.0
    best = _best_window(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(best, _best_window(" ".join(sorted(left)), " ".join(sorted(right))))


def weighted_ratio(a: str, b: str) -> float:
    """Weighted similarity of two strings, on the driver or in a task."""
    if not a or not b:
        return 0.0
    base = _ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < WINDOW_FROM:
        return max(base, _by_words(a, b) * WORDS)
    scale = WINDOW if spread <= FAR_FROM else FAR_WINDOW
    return max(base, _best_window(a, b) * scale, _window_by_words(a, b) * WORDS * scale)


@F.pandas_udf(T.DoubleType())
def _weighted_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        known: dict[tuple, float | None] = {}
        scores = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else weighted_ratio(*pair)
            scores.append(known[pair])
        yield pd.Series(scores, dtype="float64")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; ``a`` holds at most 61 letters.

    One bit per letter of ``a``; every letter of ``b`` clears the bits it can match.
    """
    size = F.length(a)
    full = _bit(size) - 1

    def mask(letter):
        return F.aggregate(
            F.sequence(F.lit(1), size), F.lit(0).cast("long"),
            lambda m, i: F.when(F.substring(a, i, F.lit(1)) == letter,
                                m.bitwiseOR(_bit(i - 1))).otherwise(m))

    def step(state, letter):
        # The match is bound once by the inner one-element fold.
        return F.aggregate(F.array(state.bitwiseAND(mask(letter))), state,
                           lambda s, hit: (s + hit).bitwiseOR(s - hit).bitwiseAND(full))

    left = F.aggregate(F.split(b, ""), full, step)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), size - F.bit_count(left)).otherwise(F.lit(0))


def _plain(a: Column, b: Column) -> Column:
    """True where only the base ratio can decide: one word each, lengths alike, short enough."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (longer < shorter * WINDOW_FROM) & (longer <= _NATIVE_LIMIT) & ~a.rlike(BLANK) & ~b.rlike(BLANK)


def similarity_of_many(a: Column, b: Column) -> Column:
    """Weighted similarity where the same few pairs come again and again: each is compared once per batch of rows.

    Null where either side is; equal names do not travel to Python.
    """
    return F.when(a == b, F.when(a == "", F.lit(0.0)).otherwise(F.lit(1.0))) \
        .otherwise(_weighted_ratio(F.when(a != b, a), F.when(a != b, b)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two columns.

    Plain pairs are computed in the JVM; only the others travel to Python, each distinct pair of a
    batch being compared once.
    """
    plain = _plain(a, b)
    near = F.lit(2.0) * common_letters(a, b) / (F.length(a) + F.length(b))
    known = (a == "") | (b == "")
    far = ~known & ~plain
    return F.when(known, F.lit(0.0)).when(a == b, F.lit(1.0)).when(plain, near) \
        .otherwise(_weighted_ratio(F.when(far & (a != b), a), F.when(far & (a != b), b)))
