"""Running totals that never sort a whole key in one task.

A window over a key holding a third of all rows would be one task. Rows are put
into order-preserving buckets instead: totals of earlier buckets come from a
window over one row per bucket, and the row-level window only spans a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tavola.functions.predicates import where_all


def _earlier(sums: DataFrame, keys: list[str], levels: list[str], names: list[str]) -> DataFrame:
    """Per bucket, the totals of all buckets before it, in place of its own."""
    outer, last = levels[:-1], levels[-1]
    before = W.partitionBy(*keys, *outer).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    here = sums.select(
        *keys, *levels, *[F.coalesce(F.sum(n).over(before), zero).alias(n) for n in names]
    )
    if not outer:
        return here
    coarse = sums.groupBy(*keys, *outer).agg(*[F.sum(n).alias(n) for n in names])
    base = _earlier(coarse, keys, outer, names).withColumnsRenamed({n: f"{n}_base" for n in names})
    return here.join(base, [*keys, *outer]).select(
        *keys, *levels, *[(F.col(n) + F.col(f"{n}_base")).alias(n) for n in names]
    )


def running_total(
    df: DataFrame,
    keys: list[str],
    buckets: dict[str, Column],
    order: list[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per `keys` in `order`.

    `buckets` are level columns, coarse to fine, that never decrease along
    `order` and are never NULL; together they bound the rows of one bucket.
    `totals` maps each new column to the value it sums, which is never negative.
    A bucket's total is its largest running sum, so both sides of the join read
    one and the same shuffle of `df` when they need the same columns.
    """
    levels = list(buckets)
    inside = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # The join below drops NULL keys; dropping them here keeps both its sides alike.
    placed = where_all(df.withColumns(buckets), *[F.col(c).isNotNull() for c in (*keys, *levels)])
    rows = placed.withColumns({n: F.sum(v).over(inside) for n, v in totals.items()})
    sums = rows.groupBy(*keys, *levels).agg(*[F.max(n).alias(f"_{n}") for n in totals])
    earlier = _earlier(sums, keys, levels, [f"_{n}" for n in totals])
    return (
        rows.join(earlier, [*keys, *levels])
        .withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals})
        .drop(*levels, *[f"_{n}" for n in totals])
    )
