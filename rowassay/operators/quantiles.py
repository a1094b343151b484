"""Exact linear-interpolated quantiles without sending a whole column to one task.

An approximate pass proposes two values around each wanted rank. A counting pass then either
finds the rank among the copies of one of them or leaves the values strictly between two of them,
which are ranked once they are few, and narrowed again otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# An interval is ranked once it holds at most this many values.
RANKED = 1_000_000
_MARGIN, _ACCURACY = 3e-4, 10_000


@dataclass
class Interval:
    """The values strictly between ``low`` and ``high`` hold the zero-based ``rank``."""

    column: str
    rank: int
    low: float | None
    high: float | None
    before: int  # values up to and including low
    within: int

    def holds(self) -> Column:
        x = F.col(self.column)
        inside = x.isNotNull()
        if self.low is not None:
            inside = inside & (x > self.low)
        if self.high is not None:
            inside = inside & (x < self.high)
        return inside


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], ranked: int = RANKED):
    """Quantiles of the non-null values, as scalars; None where there are no values."""
    return quantiles_of(df, [value], probs, ranked)[0]


def quantiles_of(
    df: DataFrame, values: list[Column], probs: list[float], ranked: int = RANKED
) -> list[list[float | None]]:
    """Quantiles of several columns; every pass serves all of them."""
    names = [f"x{i}" for i in range(len(values))]
    frame = df.select(*[v.cast("double").alias(n) for n, v in zip(names, values)])
    asks = [F.struct(F.count(n), _around(F.col(n), probs)).alias(n) for n in names]
    seen = frame.agg(*asks).first()
    out: list[list[float | None]] = [[None] * len(probs) for _ in values]
    many = [i for i, s in enumerate(seen) if s[0]]
    open_, guesses = {}, {}
    for i in many:
        n, around = seen[i]
        for j, p in enumerate(probs):
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                open_[i, rank] = Interval(names[i], rank, None, None, 0, n)
                guesses[i, rank] = (around[2 * j], around[2 * j + 1])
    at_rank: dict[tuple[int, int], float] = {}
    while open_:
        open_ = _count(frame, open_, guesses, at_rank)
        _rank(frame, {k: v for k, v in open_.items() if v.within <= ranked}, at_rank)
        open_ = {k: v for k, v in open_.items() if k not in at_rank}
        guesses = _guess(frame, open_)
    for i in many:
        for j, p in enumerate(probs):
            place = (seen[i][0] - 1) * p
            low, high = at_rank[i, math.floor(place)], at_rank[i, math.ceil(place)]
            out[i][j] = low + (high - low) * (place - math.floor(place))
    return out


def _around(x: Column, probs: list[float]) -> Column:
    cuts = [c for p in probs for c in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0))]
    return F.percentile_approx(x, cuts, _ACCURACY)


def _guess(frame: DataFrame, open_: dict) -> dict:
    """Two values of each interval, around the wanted rank."""
    if not open_:
        return {}
    asks = []
    for i, v in enumerate(open_.values()):
        p = (v.rank - v.before) / max(v.within - 1, 1)
        asks.append(_around(F.when(v.holds(), F.col(v.column)), [p]).alias(f"g{i}"))
    return dict(zip(open_, (tuple(sorted(g)) for g in frame.agg(*asks).first())))


def _count(frame: DataFrame, open_: dict, guesses: dict, at_rank: dict) -> dict:
    """Settle ranks that fall on a guess; shrink the other intervals. Counts are exact, so a
    guess that missed only moves one side."""
    asks = []
    for i, (k, v) in enumerate(open_.items()):
        x = F.col(v.column)
        for side, g in zip("ab", guesses[k]):
            asks += [F.count_if(x < g).alias(f"{side}{i}"), F.count_if(x <= g).alias(f"{side}{i}_")]
    got = frame.agg(*asks).first()
    out = {}
    for i, (k, v) in enumerate(open_.items()):
        (a, b), (a_below, a_upto, b_below, b_upto) = guesses[k], got[4 * i : 4 * i + 4]
        if v.rank < a_below:
            out[k] = Interval(v.column, v.rank, v.low, a, v.before, a_below - v.before)
        elif v.rank < a_upto:
            at_rank[k] = a
        elif v.rank < b_below:
            out[k] = Interval(v.column, v.rank, a, b, a_upto, b_below - a_upto)
        elif v.rank < b_upto:
            at_rank[k] = b
        else:
            out[k] = Interval(v.column, v.rank, b, v.high, b_upto, v.before + v.within - b_upto)
    return out


def _rank(frame: DataFrame, ready: dict, at_rank: dict) -> None:
    """Values at the wanted ranks of small intervals, in one job."""
    if not ready:
        return
    keys = list(ready)
    inside = [
        F.when(v.holds(), F.struct(F.lit(i).alias("i"), F.col(v.column).alias("x")))
        for i, v in enumerate(ready.values())
    ]
    counted = (
        frame.where(reduce(Column.__or__, [v.holds() for v in ready.values()]))
        .select(F.explode(F.array_compact(F.array(*inside))).alias("e"))
        .groupBy("e.i", "e.x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    past = F.element_at(F.array(*[F.lit(v.rank - v.before) for v in ready.values()]), F.col("i") + 1)
    upto = counted.withColumn("upto", F.expr("sum(n) over (partition by i order by x)"))
    for r in upto.where(F.col("upto") > past).groupBy("i").agg(F.min("x").alias("x")).collect():
        at_rank[keys[r["i"]]] = r["x"]
