"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(c: str | Column) -> Column:
    return F.transform(col(c), lambda x: x.cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """x to some digits as in SQL: times 10^digits, to the nearest whole number (halves away from zero), divided again.

    Spark's round goes by the decimal text of x: it differs at halves and among large numbers (1e8 and six digits), and drops the sign of zeros.
    """
    y = x * F.lit(10.0**digits)
    n = F.rint(y)
    near = F.when((y > 0) & (y - n == 0.5), n + 1).when((y < 0) & (y - n == -0.5), n - 1).otherwise(n) / F.lit(10.0**digits)
    return F.when(F.abs(y) == float("inf"), x).otherwise(near)


def rounded_list(c: str | Column, digits: int = 6) -> Column:
    return F.transform(col(c), lambda x: rounded(x, digits))


def total(c: str | Column) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(c: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(c), F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once a row: inside a lambda an outer expression is evaluated for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_normalize(c: str | Column, eps: float = 1e-8, mode: str = "add") -> Column:
    """x / (norm + eps), or x / max(norm, eps) with mode 'max'."""
    n = norm(c) + eps if mode == "add" else F.greatest(norm(c), F.lit(eps))
    return let(n, lambda m: F.transform(col(c), lambda x: x / m))


def cosine(a: str | Column, b: str | Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def logsumexp(c: str | Column, tau: float = 1.0) -> Column:
    """tau * log(sum(exp(x / tau))), from the largest."""
    return let(F.array_max(col(c)), lambda top: top + tau * F.log(F.aggregate(col(c), F.lit(0.0), lambda s, x: s + F.exp((x - top) / tau))))


def softmax(c: str | Column, tau: float = 1.0) -> Column:
    exps = let(F.array_max(col(c)), lambda top: F.transform(col(c), lambda x: F.exp((x - top) / tau)))
    return let(exps, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def entropy(c: str | Column, eps: float = 1e-12) -> Column:
    """Entropy of a distribution."""
    return -F.aggregate(col(c), F.lit(0.0), lambda s, p: s + p * F.log(F.greatest(p, F.lit(eps))))


def argmax(c: str | Column) -> Column:
    """Index from zero of the largest, the first of equals."""
    return (F.array_position(col(c), F.array_max(col(c))) - 1).cast("int")


def combine_scores(g: Column, o: Column, mode: str = "alpha", alpha: float = 0.5) -> Column:
    """Global and object score in one; without an object score the global one."""
    both = {"alpha": alpha * g + (1 - alpha) * o, "sum": g + o, "max": F.greatest(g, o)}[mode]
    return F.when(o.isNull(), g).otherwise(both)


def gaussian(c: str | Column, mu: float, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow((col(c) - mu) / sigma, F.lit(2.0))) if sigma > 0 else F.lit(0.0)


def soft_or(c: str | Column, eps: float = 1e-7) -> Column:
    """1 - product(1 - x + eps), clamped to 0 .. 1."""
    left = F.aggregate(col(c), F.lit(1.0), lambda p, x: p * (1 - x + eps))
    return F.least(F.greatest(1 - left, F.lit(0.0)), F.lit(1.0))
