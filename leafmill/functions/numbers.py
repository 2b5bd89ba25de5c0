"""Rounding that agrees with the stored scores."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=None)
def _ties_up(scale: int) -> str:
    """For each tie (n + 0.5) / scale below 1: does the double nearest to it round up?"""
    digits = len(str(scale)) - 1
    ties = [(n + 0.5) / scale for n in range(scale)]
    return "".join("1" if round(t, digits) * scale > n + 0.25 else "0" for n, t in enumerate(ties))


def round_exact(x: Column, digits: int = 3) -> Column:
    """Round a double in 0..1 by its exact binary value, ties to even.

    ``F.round`` decides a tie from the shortest decimal text of the double, so 0.0625
    and the doubles that only print like a tie go the other way. A double can only be
    in doubt when it equals the double nearest to a tie, and which way that one goes is
    known beforehand. Plain arithmetic, so it stays in codegen; ``x`` is used several
    times and should be a column, not a long expression.
    """
    scale = 10**digits
    below = F.floor(x * float(scale))
    tie = (below + 0.5) / float(scale)
    known = F.substring(F.lit(_ties_up(scale)), (below + 1).cast("int"), F.lit(1)) == "1"
    up = (x > tie) | ((x == tie) & known)
    return (below + up.cast("int")) / float(scale)


def milli(x: Column) -> Column:
    """A three-decimal score as an integer, for sums that do not depend on row order."""
    return F.round(x * 1000).cast("long")
