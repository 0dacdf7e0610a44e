"""Pools of automated market makers to virtual order books, in exact integers of any size (Arrow batches of Python ints)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICK, SLOTS = 100_000, 2048
LEVELS = "pool long, side string, position int, price_px8 long, quantity decimal(38,0), slot int"


def cut(a: int, b: int) -> int:
    """Integer division toward zero."""
    return a // b if (a >= 0) == (b > 0) else -(-a // b)


def v2_spot(base: int, quote: int, base_dec: int = 18, quote_dec: int = 6) -> int:
    return 0 if base == 0 else quote * 10 ** (base_dec - quote_dec) * 10**8 // base


def v2_spot_column(base: Column, quote: Column, base_dec: int = 18, quote_dec: int = 6) -> Column:
    """v2_spot of decimal columns, in the JVM; null where 38 digits don't hold the scaled quote, or 64 bits the price: those are for `v2_spot`."""
    scaled = F.try_multiply(quote.cast("decimal(38,0)"), F.lit(10 ** (base_dec - quote_dec + 8)).cast("decimal(38,0)")) if base_dec - quote_dec + 8 < 19 else F.try_multiply(F.try_multiply(quote.cast("decimal(38,0)"), F.lit(10**18).cast("decimal(38,0)")), F.lit(10 ** (base_dec - quote_dec - 10)).cast("decimal(38,0)"))
    whole = F.greatest(base, F.lit(1)).cast("decimal(38,0)")
    return F.when(base == 0, F.lit(0).cast("bigint")).otherwise(((scaled - scaled % whole) / whole).cast("decimal(38,0)").try_cast("bigint"))


def v2_levels(base: int, quote: int, bands: list[int], base_dec: int = 18, quote_dec: int = 6) -> list[tuple[str, int, int, int]]:
    spot, out = v2_spot(base, quote, base_dec, quote_dec), []
    for i, bps in enumerate(bands if spot > 0 else []):
        step = spot * bps // 10_000
        for side, price in (("ask", spot + step), ("bid", spot - step)):
            if price > 0:
                moved = base * isqrt(spot * 10**18 // price) // 10**9
                out.append((side, i, price, abs(base - moved) * 10**8 // 10**base_dec))
    return out


def sqrt_spot(sqrt_price_x96: int) -> int:
    p = sqrt_price_x96 >> 48
    return ((p * p >> 32) * 10**8 + (1 << 63)) >> 64


def tick_levels(spot: int, current: int, liquidity: int, ticks: list[tuple[int, int]], fee_bps: int | None = None) -> list[tuple[str, int, int, int]]:
    """Levels of concentrated liquidity; with a fee, asks start at the current tick and prices move by half of it."""
    out, depth = [], liquidity
    for i, (tick, net) in enumerate(ticks):
        if tick > current or (fee_bps is not None and tick == current):
            price = spot + (tick - current) * 100
            out.append(("ask", i, price + (cut(price * fee_bps, 20_000) if fee_bps is not None else 0), depth // 10**9))
            depth = max(depth + net, 0)
    depth = liquidity
    for i, (tick, net) in reversed(list(enumerate(ticks))):
        if tick <= current:
            price = spot - (current - tick) * 100
            price -= cut(price * fee_bps, 20_000) if fee_bps is not None else 0
            if price > 0:
                out.append(("bid", i, price, depth // 10**9))
            depth = max(depth - net, 0)
    return out


def v4_fee(fee: int, override: int | None, delta: int, before_swap: bool) -> int:
    base = (30 if override is None else override) if fee & 0x800000 else fee // 100
    return max(0, min(10_000, base + delta)) if before_swap else base


def curve_d(x: list[int], a: int) -> int:
    n, s = len(x), sum(x)
    if s == 0:
        return 0
    d, ann = s, a * n**n
    for _ in range(255):
        p = d
        for v in x:
            p = p * d // (v * n)
        last, d = d, (ann * s + p * n) * d // ((ann - 1) * d + (n + 1) * p)
        if abs(d - last) <= 1:
            break
    return d


def curve_y(i: int, j: int, new_x: int, x: list[int], a: int) -> int | None:
    n = len(x)
    if i == j or not (0 <= i < n and 0 <= j < n):
        return None
    d, ann = curve_d(x, a), a * n**n
    c, s = d, 0
    for k in range(n):
        if k != j:
            v = new_x if k == i else x[k]
            if v == 0:
                return None
            s, c = s + v, c * d // (v * n)
    c, b, y = c * d // (ann * n), s + d // ann, d
    for _ in range(255):
        low = 2 * y + b - d
        if low <= 0:
            return None
        last, y = y, (y * y + c) // low
        if abs(y - last) <= 1:
            break
    return y


def curve_out(i: int, j: int, dx_raw: int, raw: list[int], decimals: list[int], a: int, fee_bps: int) -> int:
    rates = [10 ** (18 - d) for d in decimals]
    x = [r * m for r, m in zip(raw, rates, strict=True)]
    y = curve_y(i, j, x[i] + dx_raw * rates[i], x, a)
    if y is None or x[j] <= y + 1:
        return 0
    dy = x[j] - y - 1
    return (dy - dy * fee_bps // 10_000) // rates[j]


def curve_spot(i: int, j: int, raw: list[int], decimals: list[int], a: int, fee_bps: int) -> int:
    out = curve_out(i, j, 10 ** decimals[i], raw, decimals, a, fee_bps)
    return out * 10 ** (18 - decimals[j]) * 10**8 // 10**18 if out else 10**8


def swap_impact(base: int, quote: int, fee_bps: int, buy: bool, amount: int) -> tuple[int, int, int] | None:
    """(out, spot after, impact in bps of 16 bits) of a pending swap against an unchanged pool."""
    before = v2_spot(base, quote)
    if before <= 0:
        return None
    f = amount * (10_000 - fee_bps)
    if buy:
        out = f * base // (quote * 10_000 + f)
        base, quote = (base - out, quote + amount) if base > out else (base, quote)
    else:
        out = f * quote // (base * 10_000 + f)
        base, quote = (base + amount, quote - out) if quote > out else (base, quote)
    after = v2_spot(base, quote)
    return out, after, (abs(after - before) * 10_000 // before) & 0xFFFF


def mapped(df: DataFrame, schema: str, f: Callable[[dict], list[tuple]]) -> DataFrame:
    """f of each row, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(made.names, r, strict=True)) for x in b.to_pylist() for r in f(x)]
            yield pa.RecordBatch.from_pylist(rows, made)

    return df.mapInArrow(run, schema)


def slot_of(price: int, base: int) -> int | None:
    """The ladder slot of an ask written past update_ask: signed distance; null outside the window."""
    slot = cut(price - base, TICK)
    return slot if 0 <= slot < SLOTS else None
