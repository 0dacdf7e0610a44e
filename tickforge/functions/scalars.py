"""Scalar functions of the market-data model, as column expressions. Prices and quantities are longs scaled by 10^8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000


def fixed8(text: Column) -> Column:
    """Decimal text to a long scaled by 10^8; more than eight decimals are cut, not rounded.

    Only a leading minus, points and digits count: "1e5" is 15, "abc" and "" are 0, and decimals are those behind the last
    point. Null for null, and where the digits don't fit in a long; never an error.
    """
    clean = text.rlike(r"^-?[0-9]{1,10}(\.[0-9]{1,8})?$")
    exact = (text.try_cast("decimal(18,8)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(28,0)").cast("bigint")
    digits = F.regexp_replace(text, "[^0-9]", "")
    decimals = F.length(F.regexp_replace(F.regexp_extract(text, r"\.([^.]*)$", 1), "[^0-9]", ""))
    scaled = F.when(decimals <= 8, F.concat(F.lit("0"), digits, F.repeat(F.lit("0"), 8 - decimals))).otherwise(F.concat(F.lit("0"), F.left(digits, F.length(digits) - decimals + 8)))
    value = scaled.try_cast("bigint")
    return F.when(clean, exact).when(text.startswith("-"), -value).otherwise(value)


def text8(value: Column) -> Column:
    """A long scaled by 10^8 to text with eight decimals."""
    whole = F.abs(value)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(whole / F.lit(SCALE).cast("decimal(20,0)")).cast("bigint").cast("string"), F.lit("."), F.lpad((whole % SCALE).cast("string"), 8, "0"))


def iso_ns(text: Column) -> Column:
    """UTC ISO-8601 text with up to nine decimals to nanoseconds since 1970; null for anything else.

    Days up to 31 are taken in every month and roll over into the next (30 February is 2 March or 1 March), and a second 60 into the next minute.
    """
    ok = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d*)?Z$")
    part = lambda at, n: F.substring(text, at, n).try_cast("int")
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    month, day = part(6, 2), part(9, 2)
    year = part(1, 4) - F.when(month <= 2, 1).otherwise(0)  # years from March, so that a leap day is the last
    days = year * 365 + whole(year, 4) - whole(year, 100) + whole(year, 400) + whole(153 * ((month + 9) % 12) + 2, 5) + day - 719_469
    seconds = days.cast("bigint") * 86_400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d*)Z$", 1), 1, 9), 9, "0").try_cast("bigint")
    return F.when(ok, F.when(days >= 0, F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000).cast("bigint")), fraction)))


def spread_bps(bid: Column, ask: Column) -> Column:
    """(ask - bid) / bid in basis points, cut, in 16 bits; 0 unless ask > bid > 0; null if the spread times 10,000 is no long."""
    scaled, by = F.try_multiply(F.try_subtract(ask, bid), F.lit(10_000).cast("bigint")), F.greatest(bid, F.lit(1).cast("bigint"))
    cut = F.call_function("div", scaled, by)  # in whole numbers: doubles are too short for it
    return F.when((bid > 0) & (ask > bid), cut.bitwiseAND(F.lit(65535).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).cast("int")


def topic_key(venue: Column, market: Column, stream: Column | int, flags: Column | int) -> Column:
    """venue (8 bits) | market (24) | stream (8) | flags (24), as a signed long."""
    as_long = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("bigint")
    low = lambda c, bits: as_long(c).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return F.shiftleft(low(venue, 8), 56) + F.shiftleft(low(market, 24), 32) + F.shiftleft(low(stream, 8), 24) + low(flags, 24)


def key_parts(key: Column) -> dict[str, Column]:
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return {"venue": low(F.shiftrightunsigned(key, 56), 8), "market_id": low(F.shiftrightunsigned(key, 32), 24), "stream_type": low(F.shiftrightunsigned(key, 24), 8), "flags": low(key, 24)}


def elapsed(later: Column, earlier: Column) -> Column:
    """A latency that is never negative."""
    return F.greatest(later - earlier, F.lit(0).cast("bigint"))


def quantile_at(values: Column, numerator: int, denominator: int) -> Column:
    """sorted[min(n * numerator / denominator, n - 1)] of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), (F.least(F.floor(n * F.lit(numerator) / F.lit(denominator)), n - 1) + 1).cast("int"))


def scanned(payload: Column, key: str) -> Column:
    """The text value of the first `"key":` at any depth, a string up to the next quote or a bare number; null if there is none."""
    found = F.regexp_extract(payload, f'"{key}":[ \\t]*("[^"]*"|[^",}}\\]\\s][^,}}\\]\\s]*)', 1)
    return F.btrim(F.nullif(found, F.lit("")), F.lit('"'))


# Numbers of venues, chains and sides.
NAMES = {
    "venue": {1: "BINANCE", 2: "COINBASE", 3: "BYBIT", 4: "OKX", 101: "UNISWAP_V2", 102: "UNISWAP_V3", 103: "CURVE", 104: "UNISWAP_V4", 201: "RAYDIUM", 202: "ORCA"},
    "chain": {0: "OFF_CHAIN", 1: "ETHEREUM", 10: "OPTIMISM", 56: "BSC", 501: "SOLANA", 8453: "BASE", 42161: "ARBITRUM"},
    "side": {1: "BUY", 2: "SELL", 3: "TWO_SIDED"},
}


def named(kind: str, number: Column) -> Column:
    """The name of a venue, chain or side; null if there is none."""
    known = F.create_map(*(F.lit(x) for pair in NAMES[kind].items() for x in pair))
    return F.try_element_at(known, number.cast("int"))


# Permission bits in the first two bytes of a hook's address.
HOOKS = [
    "after_remove_liquidity_returns_delta", "after_add_liquidity_returns_delta", "after_swap_returns_delta", "before_swap_returns_delta", "after_donate", "before_donate", "after_swap", "before_swap",
    "after_remove_liquidity", "before_remove_liquidity", "after_add_liquidity", "before_add_liquidity", "after_initialize", "before_initialize",
]


def hook_flags(address: Column) -> Column:
    """The first two bytes of an address, big-endian; null if it has fewer."""
    return F.when(F.length(address) >= 2, F.conv(F.hex(F.substring(address, 1, 2)), 16, 10).cast("int"))


def has_hook(address: Column, name: str) -> Column:
    return hook_flags(address).bitwiseAND(F.lit(1 << HOOKS.index(name))) != 0


def has_dynamic_fee(fee: Column) -> Column:
    return fee.bitwiseAND(F.lit(0x800000)) != 0


def backoff_s(failures: Column) -> Column:
    """Seconds to wait before the next connection after so many failures in a row: 1, 2, 4, ... at most 30."""
    return F.least(F.lit(30), F.pow(F.lit(2), F.least(failures - 1, F.lit(5))).cast("int"))
