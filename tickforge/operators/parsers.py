"""Raw exchange payloads to typed columns. A row with a required field missing, or a number that is no long, has ok = false and goes to quarantine."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _long(text: Column) -> Column:
    return F.regexp_extract(text, r"^ *(\d+)", 1).try_cast("bigint")


def _ns(ms: Column) -> Column:
    return F.coalesce(F.try_multiply(_long(ms), F.lit(1_000_000).cast("bigint")), F.lit(0).cast("bigint"))


class _Texts:
    """The texts of some keys of a payload, cut out once in a projection of their own."""

    def __init__(self, messages: DataFrame, *keys: str):
        self.keys, self.columns = keys, messages.columns
        self.rows = messages.withColumn("__ps_texts", F.array(*(S.scanned(F.col("payload"), k) for k in keys)))

    def __getitem__(self, key: str) -> Column:
        return F.get("__ps_texts", F.lit(self.keys.index(key)))

    def parsed(self, fields: dict[str, Column], required: list[str]) -> DataFrame:
        """The messages with `fields`, and ok where all of the required ones are there."""
        kept = [c for c in self.columns if c.lower() not in {n.lower() for n in fields}]
        out = self.rows.select(*kept, *(c.alias(n) for n, c in fields.items()))
        return out.withColumn("ok", reduce(and_, (F.col(n).isNotNull() for n in required)))

    def quote(self, bid: str, bid_size: str, ask: str, ask_size: str) -> dict[str, Column]:
        return {"bid_px8": S.fixed8(self[bid]), "bid_qty8": S.fixed8(self[bid_size]), "ask_px8": S.fixed8(self[ask]), "ask_qty8": S.fixed8(self[ask_size])}


QUOTED = ["bid_px8", "bid_qty8", "ask_px8", "ask_qty8"]


def _with_spread(df: DataFrame) -> DataFrame:
    out = df.withColumn("spread_bps", S.spread_bps(F.col("bid_px8"), F.col("ask_px8")))
    return out.withColumn("ok", F.col("ok") & F.col("spread_bps").isNotNull())


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; a parser never fails, and what it can't read is bad."""
    return parsed.filter("ok").drop("ok"), parsed.filter("not ok").drop("ok")


def _zero(text: Column) -> Column:
    return F.coalesce(_long(text), F.lit(0).cast("bigint"))


def binance_bbo(messages: DataFrame) -> DataFrame:
    t = _Texts(messages, "b", "B", "a", "A", "E", "u")
    fields = t.quote("b", "B", "a", "A") | {"t0_ns": _ns(t["E"]), "sequence": _zero(t["u"])}
    return _with_spread(t.parsed(fields, QUOTED)).withColumn("venue", F.lit(1))


def binance_trade(messages: DataFrame) -> DataFrame:
    t = _Texts(messages, "p", "q", "T", "t")
    maker = F.col("payload").rlike('"m":[ \\t]*true')
    fields = {"price_px8": S.fixed8(t["p"]), "size_qty8": S.fixed8(t["q"]), "t0_ns": _ns(t["T"]), "trade_id": _zero(t["t"]), "sequence": _zero(t["t"]), "side": F.when(maker, 2).otherwise(1)}
    return t.parsed(fields, ["price_px8", "size_qty8"]).withColumn("venue", F.lit(1))


def okx_bbo(messages: DataFrame) -> DataFrame:
    """The time is a plain count of milliseconds, which is also the sequence."""
    t = _Texts(messages, "bidPx", "bidSz", "askPx", "askSz", "ts")
    fields = t.quote("bidPx", "bidSz", "askPx", "askSz") | {"t0_ns": _ns(t["ts"]), "sequence": _zero(t["ts"])}
    return _with_spread(t.parsed(fields, QUOTED)).withColumn("venue", F.lit(4))


def coinbase_bbo(messages: DataFrame) -> DataFrame:
    t = _Texts(messages, "best_bid", "best_bid_size", "best_ask", "best_ask_size", "sequence", "time")
    fields = t.quote("best_bid", "best_bid_size", "best_ask", "best_ask_size") | {"sequence": _long(t["sequence"]), "t0_ns": F.coalesce(S.iso_ns(t["time"]), F.lit(0).cast("bigint"))}
    return _with_spread(t.parsed(fields, [*QUOTED, "sequence"])).withColumn("venue", F.lit(2))


def coinbase_trade(messages: DataFrame) -> DataFrame:
    t = _Texts(messages, "price", "last_size", "side", "trade_id", "sequence")
    fields = {"price_px8": S.fixed8(t["price"]), "size_qty8": S.fixed8(t["last_size"]), "side_text": t["side"], "trade_id": _long(t["trade_id"]), "sequence": _zero(t["sequence"])}
    out = t.parsed(fields, ["price_px8", "size_qty8", "side_text", "trade_id"])
    return out.withColumn("side", F.when(F.col("side_text") == "sell", 2).otherwise(1)).withColumn("venue", F.lit(2)).drop("side_text")


def message_fields(messages: DataFrame) -> DataFrame:
    """type, product_id, sequence and trade_id (else last_trade_id) of any message."""
    t = _Texts(messages, "type", "product_id", "sequence", "trade_id", "last_trade_id")
    fields = {"type": t["type"], "product_id": t["product_id"], "sequence": _long(t["sequence"]), "trade_id": F.coalesce(_long(t["trade_id"]), _long(t["last_trade_id"]))}
    return t.parsed(fields, ["type"]).drop("ok")


def client_command(messages: DataFrame) -> DataFrame:
    """ping, pong, subscribe or unsubscribe, by the first that the text has; an unsubscription's flags are 0."""
    said = lambda word: F.col("payload").rlike(f'"(action|type)": ?"{word}"')
    get = lambda key: _long(S.scanned(F.col("payload"), key))
    action = F.when(said("ping"), "ping").when(said("pong"), "pong").when(said("subscribe"), "subscribe").when(said("unsubscribe"), "unsubscribe")
    key = S.topic_key(get("venue"), get("market_id"), get("stream_type"), F.when(F.col("action") == "subscribe", F.coalesce(get("flags"), F.lit(0))).otherwise(0))
    return messages.withColumn("action", action).withColumn("topic_key", F.when(F.col("action").isin("subscribe", "unsubscribe"), key))


def raydium_account(accounts: DataFrame) -> DataFrame:
    """(data binary, slot long) to a quote; accounts of under 64 bytes are not ok."""
    price = F.conv(F.concat(*(F.hex(F.substring("data", i, 1)) for i in range(24, 16, -1))), 16, 10)
    bid = F.least(price.cast("decimal(38,0)") * 100, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    out = accounts.withColumn("ok", F.length("data") >= 64).withColumn("bid_px8", F.when(F.col("ok"), bid))
    return out.withColumn("ask_px8", F.expr("bid_px8 + bid_px8 * 5 div 10000")).withColumn("t0_ns", F.col("slot") * 400_000_000).withColumns({"venue": F.lit(201), "chain": F.lit(501), "flags": F.lit(1), "spread_bps": F.lit(5)})
