"""Small column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bigint(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def ladder(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def ratio(a, b) -> Column:
    """a / b in double precision, null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column, digits: int = 9) -> Column:
    return F.round(c, digits)


def quantile_disc(name: str, p: float) -> Column:
    """The nearest-rank quantile as a whole number."""
    return F.expr(f"percentile_disc({p}) within group (order by {name})").cast("long")


#: How far from its share a quantile is looked for: the approximate one is ten times as exact.
REACH, ACCURACY = 1e-4, 100_000


def nearest_rank(rows: DataFrame, column: str, shares: tuple[float, ...]) -> tuple[int, list[float | None]]:
    """How many values are not null, and for each share the value of that rank (rounded up), exactly.

    Approximate quantiles just below and above bracket the rank; values below the bracket are counted, and only those inside it are
    sorted, so that no task holds all values.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-REACH, REACH)]
    head = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", ends, ACCURACY).alias("ends")).first()
    n = head["n"]
    if not n:
        return 0, [None] * len(shares)
    ranks = [max(math.ceil(round(p * n, 6)), 1) for p in shares]
    pairs = [(F.lit(head["ends"][2 * k]), F.lit(head["ends"][2 * k + 1])) for k in range(len(shares))]
    counts = x.agg(*[c for k, (lo, hi) in enumerate(pairs) for c in (F.count_if(F.col("x") < lo).alias(f"b{k}"),
        F.count_if(F.col("x").between(lo, hi)).alias(f"m{k}"))]).first()
    inside = [F.when(F.col("x").between(lo, hi), F.col("x")).alias(f"x{k}") for k, (lo, hi) in enumerate(pairs)]
    q = [(r - counts[f"b{k}"] - 0.5) / counts[f"m{k}"] for k, r in enumerate(ranks)]
    found = x.select(*inside).agg(*[F.expr(f"percentile_disc({min(max(v, 0.0), 1.0)}) within group (order by x{k})").alias(f"q{k}") for k, v in enumerate(q)]).first()
    return n, [found[f"q{k}"] for k in range(len(shares))]


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def words_of(pattern: str) -> str:
    """pattern between ASCII word borders, which Java's own border is not."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"
