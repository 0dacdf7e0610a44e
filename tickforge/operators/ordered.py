"""Running values over long keys: a key's rows are cut to ranges of their order, so that a market with a third of all rows is many tasks.

Each range is summed up first (partial aggregates); what comes before or after a range is carried over its key's ranges, of which there are
few, and meets the rows in a join. Windows then run within ranges. `order` is a long; ranges are `span` of it wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SPAN = 1 << 18
_RANGE = "__or_range"


def _cut(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn(_RANGE, F.expr(f"CAST(floor(`{order}` / {span}) AS BIGINT)"))


def _within(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, _RANGE).orderBy(order)


def _joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carry, [*keys, _RANGE])


def running(df: DataFrame, keys: list[str], order: str, made: dict[str, tuple[str, str]], before: bool = False, span: int = SPAN) -> DataFrame:
    """`df` with columns {name: ('max' | 'min' | 'sum', column)} over a key's rows up to each row, or `before` it (null for the first)."""
    rows, of = _cut(df, order, span), {"max": F.max, "min": F.min, "sum": F.sum}
    upto = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, _RANGE).agg(*(of[f](c).alias(f"__or_{n}") for n, (f, c) in made.items()))
    carry = carry.select(*keys, _RANGE, *(of[f](f"__or_{n}").over(upto).alias(f"__or_{n}") for n, (f, _) in made.items()))
    frame = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def whole(n: str, f: str, c: str) -> Column:
        here, there = of[f](c).over(frame), F.col(f"__or_{n}")
        if f == "sum":
            return F.when(here.isNull() & there.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)))
        return (F.greatest if f == "max" else F.least)(here, there)

    out = _joined(rows, carry, keys)
    return out.withColumns({n: whole(n, f, c) for n, (f, c) in made.items()}).drop(_RANGE, *(f"__or_{n}" for n in made))


def neighbour(df: DataFrame, keys: list[str], order: str, made: dict[str, str], after: bool = False, span: int = SPAN) -> DataFrame:
    """`df` with columns {name: column} of the row before (or `after`) each row in its key; null at the end. Orders are unique in a key."""
    rows, ends = _cut(df, order, span), (F.min_by if after else F.max_by)
    w = Window.partitionBy(*keys).orderBy(_RANGE)
    shift = F.lead if after else F.lag
    carry = rows.groupBy(*keys, _RANGE).agg(*(ends(F.struct(c), order).alias(f"__or_{n}") for n, c in made.items()))
    carry = carry.select(*keys, _RANGE, *(shift(f"__or_{n}").over(w).alias(f"__or_{n}") for n in made))
    out = _joined(rows, carry, keys)
    within = _within(keys, order)
    found = {n: F.coalesce(shift(F.struct(F.col(c).alias("v"))).over(within), F.struct(F.col(f"__or_{n}").getField(c).alias("v")))["v"] for n, c in made.items()}
    return out.withColumns(found).drop(_RANGE, *(f"__or_{n}" for n in made))


def last_known(df: DataFrame, keys: list[str], order: str, made: dict[str, str], span: int = SPAN) -> DataFrame:
    """`df` with columns {name: column} of the nearest row before each row in its key where the column is not null."""
    rows = _cut(df, order, span)
    carry = rows.groupBy(*keys, _RANGE).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__or_{n}") for n, c in made.items()))
    upto = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*keys, _RANGE, *(F.last(f"__or_{n}", ignorenulls=True).over(upto).alias(f"__or_{n}") for n in made))
    frame = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(rows, carry, keys)
    return out.withColumns({n: F.coalesce(F.last(c, ignorenulls=True).over(frame), F.col(f"__or_{n}")) for n, c in made.items()}).drop(_RANGE, *(f"__or_{n}" for n in made))
