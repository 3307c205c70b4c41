"""Exact quantiles of all rows, without a task that holds all values.

A mergeable sketch gives each quantile a range that its rank lies in. Counting what is below
and within the ranges shows that it does, and of the few rows within, values are counted; a
range of too many rows gets a narrower one of its own first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's ranks are right to one in so many.
ACCURACY = 10_000
#: Shares of the rows to either side of a rank that a range may take; the last takes all.
SIDES = (2 / ACCURACY, 0.01, 1.0)
#: Rows of a range whose values are counted; all in one come to the driver, a row for each value.
MOST = 50_000


def _sketch(value: Column, share: float) -> Column:
    """The ends of ranges about a share, a pair for each of SIDES."""
    ends = [min(1.0, max(0.0, share + sign * side)) for side in SIDES for sign in (-1, 1)]
    return F.percentile_approx(value, F.array(*map(F.lit, ends)), ACCURACY)


def _within(value: Column, low: float, high: float) -> Column:
    return value.between(F.lit(low), F.lit(high))


def _narrowed(rows: DataFrame, value: Column, found: dict[float, tuple[float, float]], ranks: dict[float, tuple[int, int]]) -> dict[float, tuple[float, float, int, int]]:
    """Ranges with how many rows are below and within, made narrower while they hold too many. A row must be of few enough, of one value, or of a range that the sketch can't cut."""
    counted = lambda r: [x for low, high in r.values() for x in (F.count_if(value < low), F.count_if(_within(value, low, high)))]
    counts = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(counted(found))]).first()
    out = {q: (*ends, counts[2 * k], counts[2 * k + 1]) for k, (q, ends) in enumerate(found.items())}
    whole = None
    for q, (_, _, below, inside) in list(out.items()):
        if not below <= ranks[q][0] <= ranks[q][1] < below + inside:  # the sketch was off: all rows
            whole = whole or rows.agg(F.min(value), F.max(value), F.count(value)).first()
            out[q] = (whole[0], whole[1], 0, whole[2])
    large = [q for q, (low, high, _, inside) in out.items() if inside > MOST and low < high]
    if large:
        each = rows.agg(*[_sketch(F.when(_within(value, *out[q][:2]), value), (ranks[q][0] - out[q][2]) / (out[q][3] - 1)).alias(f"s{k}") for k, q in enumerate(large)]).first()
        closer = {q: (each[k][0], each[k][1]) for k, q in enumerate(large)}
        closer = {q: ends for q, ends in closer.items() if ends != out[q][:2]}
        if closer:
            again = _narrowed(rows, value, closer, ranks)
            out |= {q: r for q, r in again.items() if r[3] < out[q][3]}
    return out


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], *more: Column) -> tuple[int, list[float | None], list]:
    """How many values a column has, its quantiles at the shares (between two ranks in proportion; null without values), and ``more`` aggregates of the rows, taken in the first pass.

    Two passes over the rows, and two more for each 2500-fold of rows beyond. Nulls don't count.
    """
    value = F.col(column).cast("double")
    first = rows.agg(F.count(value).alias("n"), *[_sketch(value, q).alias(f"q{k}") for k, q in enumerate(shares)], *[c.alias(f"m{k}") for k, c in enumerate(more)]).first()
    n, extra = first["n"], [first[f"m{k}"] for k in range(len(more))]
    if not n:
        return 0, [None] * len(shares), extra
    ranks = {q: (math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in shares}
    side = next(k for k, s in enumerate(SIDES) if s >= 3 / n or k == len(SIDES) - 1)
    found = {q: (first[f"q{k}"][2 * side], first[f"q{k}"][2 * side + 1]) for k, q in enumerate(shares)}
    ranges = _narrowed(rows, value, found, ranks)
    any_ = F.lit(False)
    for low, high, _, _ in ranges.values():
        any_ = any_ | _within(value, low, high)
    counts = sorted((r["v"], r["count"]) for r in rows.where(any_).groupBy(value.alias("v")).count().collect())
    out: list[float | None] = []
    for q in shares:
        low, high, below, _ = ranges[q]
        own = [(v, c) for v, c in counts if low <= v <= high]

        def at(rank: int, own: list = own, below: int = below) -> float:
            for v, c in own:
                below += c
                if rank < below:
                    return v
            raise AssertionError("a rank outside its range")

        a, b = (at(r) for r in ranks[q])
        out.append(a + (b - a) * (q * (n - 1) - ranks[q][0]))
    return n, out, extra
