"""Maximal scoring segments of a sequence."""

from __future__ import annotations

from collections.abc import Sequence


def segments_between(firsts: Sequence[int], lasts: Sequence[int], lows: Sequence[float], highs: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), by the linear scan of Ruzzo and Tompa.

    The sequence is given by its positive runs (from ``firsts`` to ``lasts``, in order, apart) and by
    the running sum of all scores before and after each of them.
    """
    # first, last, sum before, sum after, nearest earlier segment that starts lower
    stack: list[tuple[int, int, float, float, int]] = []
    for first, b, low, high in zip(firsts, lasts, lows, highs, strict=True):
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, b, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            link = stack[j][4]
            del stack[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def maximal_segments(firsts: Sequence[int], lasts: Sequence[int], scores: Sequence[float], drift: float) -> list[tuple[int, int, float]]:
    """segments_between() of runs with these scores where every position outside a run costs ``drift``."""
    lows, highs, total, end = [], [], 0.0, -1
    for a, b, s in zip(firsts, lasts, scores, strict=True):
        total -= drift * (a - end - 1)
        lows.append(total)
        total += s
        highs.append(total)
        end = b
    return segments_between(firsts, lasts, lows, highs)
