"""The query catalogue: each entry is a plan over the driver's tables, most with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import amm, codec, folds, ordered, parsers, rings, router, session, websocket
from ..sources import adapters as A
from ..sources import simulator

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The adapters' tables in DuckDB.
BBO = """b0 AS (SELECT event_id AS ord, event_id AS sequence, user_id % 10 + 1 AS market_id,
  (CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'signup' THEN 102 ELSE 201 END)::INTEGER AS venue,
  epoch_us(ts) * 1000 AS t0_ns, round(value * 100)::BIGINT * 1000000 AS mid, json_extract_string(props, '$.k')::BIGINT AS k, ts FROM events),
b1 AS (SELECT *, mid - mid * (k % 30 + 1) // 20000 AS bid_px8, mid + mid * (k % 30 + 1) // 20000 AS ask_px8, (k + 1) * 100000000 AS bid_qty8, (100 - k) * 100000000 AS ask_qty8,
  (ord % 2)::INTEGER AS flags, t0_ns + ord * 7919 % 3301 + 200 AS t1_ns FROM b0),
b2 AS (SELECT *, t1_ns + ord * 104729 % 1001 + 500 AS t2_ns FROM b1),
bbo AS (SELECT *, t2_ns + ord * 1299709 % 601 + 200 AS t3_ns, 0 AS chain,
  (CASE WHEN bid_px8 > 0 AND ask_px8 > bid_px8 THEN ((ask_px8 - bid_px8) * 10000 // bid_px8) & 65535 ELSE 0 END)::INTEGER AS spread_bps FROM b2)"""
TRADES = """trades AS (SELECT o_orderkey AS ord, o_orderkey AS trade_id, o_orderkey AS sequence, o_custkey % 10 + 1 AS market_id, (o_custkey % 2 + 1)::INTEGER AS venue,
  round(o_totalprice * 100)::BIGINT * 1000000 AS price_px8, (o_custkey % 7 + 1) * 10000000 AS size_qty8,
  CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS side, o_orderpriority = '1-URGENT' AS is_liquidation FROM orders)"""
CLIENTS = """clients AS (SELECT c_custkey AS client_id, CASE c_custkey % 2 WHEN 0 THEN 'sbe' ELSE 'json' END AS protocol, c_custkey % 4 AS state,
  c_nationkey AS max_spread_bps, greatest(c_acctbal, 0) AS min_notional_usd FROM customer),
subs AS (SELECT c_custkey AS client_id, [1, 2, 4, 102, 201][c_nationkey % 5 + 1] AS venue, c_custkey % 10 + 1 AS market_id, s AS stream, CASE s WHEN 1 THEN c_nationkey % 2 ELSE 0 END AS flags
  FROM customer, (VALUES (1), (3)) x(s) WHERE c_custkey < 1024)"""
MATCHED = """m AS (SELECT DISTINCT bbo.ord, spread_bps, client_id FROM bbo JOIN subs ON subs.stream = 1 AND subs.venue = bbo.venue AND subs.market_id = bbo.market_id AND (subs.flags = bbo.flags OR subs.flags = 0)),
j AS (SELECT m.ord, m.client_id, protocol, CASE WHEN state IS NULL OR state NOT IN (1, 2) THEN 'inactive' WHEN max_spread_bps > 0 AND spread_bps > max_spread_bps THEN 'filtered' ELSE 'candidate' END AS verdict
  FROM m LEFT JOIN clients USING (client_id))"""
TEXT8 = lambda c: f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100000000)::VARCHAR || '.' || lpad((abs({c}) % 100000000)::VARCHAR, 8, '0'))"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# scalars

@query("bbo_normalize", f"WITH {BBO} SELECT ord, market_id, venue, bid_px8, ask_px8, spread_bps FROM bbo")
def bbo_normalize(s, d):
    return A.bbo(s, d).select("ord", "market_id", "venue", "bid_px8", "ask_px8", "spread_bps")


_DIGITS = "concat(CAST(event_id % 1000 AS STRING), '.', lpad(CAST(event_id * 7919 % 10000000000 AS STRING), 10, '0'))"


@query("fixed_point_parse", "SELECT event_id, event_id % 1000 * 100000000 + event_id * 7919 % 10000000000 // 100 AS px8 FROM events")
def fixed_point_parse(s, d):
    return A.read(s, d, "events").select("event_id", S.fixed8(F.expr(_DIGITS)).alias("px8"))


_DIRTY = "CASE event_id % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '1e5' WHEN 2 THEN '99999999999999999999' WHEN 3 THEN '1.2.3' WHEN 4 THEN '-7' WHEN 5 THEN '' WHEN 6 THEN '12x3.4y567890123' WHEN 7 THEN '--1.5-' ELSE '.25' END"


@query("fixed_point_dirty", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 1500000000 WHEN 3 THEN 1230000000 WHEN 4 THEN -700000000 WHEN 5 THEN 0 WHEN 6 THEN 12345678901 WHEN 7 THEN -150000000 WHEN 8 THEN 25000000 END::BIGINT AS px8 FROM events")
def fixed_point_dirty(s, d):
    return A.read(s, d, "events").select("event_id", S.fixed8(F.expr(_DIRTY)).alias("px8"))


@query("fixed_point_format", f"WITH {BBO} SELECT ord, {TEXT8('bid_px8 - 5000000000')} AS bid, {TEXT8('ask_px8')} AS ask FROM bbo")
def fixed_point_format(s, d):
    return A.bbo(s, d).select("ord", S.text8(F.col("bid_px8") - 5_000_000_000).alias("bid"), S.text8(F.col("ask_px8")).alias("ask"))


@query("topic_key_pack", f"WITH {BBO} SELECT ord, upper(printf('%016x', (venue::UBIGINT << 56) + (market_id::UBIGINT << 32) + (1::UBIGINT << 24) + flags::UBIGINT)) AS topic FROM bbo")
def topic_key_pack(s, d):
    return A.bbo(s, d).select("ord", F.lpad(F.hex(S.topic_key(F.col("venue"), F.col("market_id"), 1, F.col("flags"))), 16, "0").alias("topic"))


@query("topic_key_unpack", f"WITH {BBO} SELECT ord, venue::BIGINT AS venue, market_id, 1::BIGINT AS stream_type, flags::BIGINT AS flags FROM bbo")
def topic_key_unpack(s, d):
    keyed = A.bbo(s, d).select("ord", S.topic_key(F.col("venue"), F.col("market_id"), 1, F.col("flags")).alias("key"))
    return keyed.select("ord", *(c.alias(n) for n, c in S.key_parts(F.col("key")).items()))


@query("iso8601_to_ns", f"WITH {BBO} SELECT ord, epoch_us(date_trunc('second', ts)) * 1000 + k * 10000000 AS ns, NULL::BIGINT AS bad FROM bbo")
def iso8601_to_ns(s, d):
    text = F.concat(F.date_format(F.timestamp_micros(F.expr("t0_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("Z"))
    return A.bbo(s, d).select("ord", S.iso_ns(text).alias("ns"), S.iso_ns(F.regexp_replace(text, "Z$", "")).alias("bad"))


@query("latency_breakdown", f"WITH {BBO} SELECT ord, greatest(t2_ns - t1_ns, 0) AS processing_ns, greatest(t3_ns - t1_ns, 0) AS egress_ns, t1_ns - t0_ns AS transit_ns FROM bbo")
def latency_breakdown(s, d):
    c = F.col
    return A.bbo(s, d).select("ord", S.elapsed(c("t2_ns"), c("t1_ns")).alias("processing_ns"), S.elapsed(c("t3_ns"), c("t1_ns")).alias("egress_ns"), (c("t1_ns") - c("t0_ns")).alias("transit_ns"))


_AT = lambda num, den: f"max(x) FILTER (i = least(n * {num} // {den}, n - 1))"
_RANKED = "r AS (SELECT venue, x, row_number() OVER (PARTITION BY venue ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM l)"


@query("latency_percentiles", f"WITH {BBO}, l AS (SELECT venue, t3_ns - t1_ns AS x FROM bbo), {_RANKED} SELECT venue, {_AT(50, 100)} AS p50, {_AT(90, 100)} AS p90, {_AT(99, 100)} AS p99, {_AT(999, 1000)} AS p999, max(x) AS worst FROM r GROUP BY venue")
def latency_percentiles(s, d):
    """By rank, not by collecting: a venue's rows may be a third of all."""
    rows = A.bbo(s, d).select("venue", (F.col("t3_ns") - F.col("t1_ns")).alias("x"))
    counts = rows.groupBy("venue", "x").agg(F.count("*").alias("c"))  # one row for each value, whatever the number of events
    w = Window.partitionBy("venue")
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy("x"))).withColumn("n", F.sum("c").over(w))
    at = lambda num, den: F.min(F.when(F.col("upto") > F.expr(f"least(n * {num} div {den}, n - 1)"), F.col("x")))
    return upto.groupBy("venue").agg(at(50, 100).alias("p50"), at(90, 100).alias("p90"), at(99, 100).alias("p99"), at(999, 1000).alias("p999"), F.max("x").alias("worst"))


@query("median_transit", f"WITH {BBO}, l AS (SELECT venue, t1_ns - t0_ns AS x FROM bbo), {_RANKED} SELECT venue, {_AT(1, 2)} AS median_ns FROM r GROUP BY venue")
def median_transit(s, d):
    rows = A.bbo(s, d).select("venue", (F.col("t1_ns") - F.col("t0_ns")).alias("x"))
    counts = rows.groupBy("venue", "x").agg(F.count("*").alias("c"))
    w = Window.partitionBy("venue")
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy("x"))).withColumn("n", F.sum("c").over(w))
    return upto.groupBy("venue").agg(F.min(F.when(F.expr("upto > least(n div 2, n - 1)"), F.col("x"))).alias("median_ns"))


@query("batch_mean", f"WITH {BBO} SELECT sum(t3_ns - t1_ns)::BIGINT // count(*) AS mean_ns, count(*) AS messages FROM bbo")
def batch_mean(s, d):
    return A.bbo(s, d).agg(F.sum(F.expr("t3_ns - t1_ns")).alias("x"), F.count("*").alias("messages")).selectExpr("x div messages AS mean_ns", "messages")


_NAMED = lambda kind, c: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.NAMES[kind].items()) + " END"


@query("enum_names", f"WITH {BBO} SELECT ord, {_NAMED('venue', 'venue')} AS venue_name, {_NAMED('chain', '[0, 1, 10, 56, 501, 8453, 42161, 7][ord % 8 + 1]')} AS chain_name, {_NAMED('side', 'ord % 4')} AS side_name FROM bbo")
def enum_names(s, d):
    chain = F.element_at(F.array(*map(F.lit, [*S.NAMES["chain"], 7])), (F.col("ord") % 8 + 1).cast("int"))
    return A.bbo(s, d).select("ord", S.named("venue", F.col("venue")).alias("venue_name"), S.named("chain", chain).alias("chain_name"), S.named("side", (F.col("ord") % 4).cast("int")).alias("side_name"))


# parsers: payloads are made from known columns and parsed back

def _payloads(s, d, text: str) -> DataFrame:
    b = A.bbo(s, d).withColumns({"bid": S.text8(F.col("bid_px8")), "ask": S.text8(F.col("ask_px8")), "bq": S.text8(F.col("bid_qty8")), "aq": S.text8(F.col("ask_qty8"))})
    return b.select("ord", F.expr(text).alias("payload"))


_PARSED = f"WITH {BBO} SELECT ord, bid_px8, bid_qty8, ask_px8, ask_qty8, t0_ns // 1000000 * 1000000 AS t0_ns, {{seq}} AS sequence, spread_bps FROM bbo"
_QUOTE = ["ord", "bid_px8", "bid_qty8", "ask_px8", "ask_qty8", "t0_ns", "sequence", "spread_bps"]


def _ms_payload(s, d, text: str) -> DataFrame:
    b = A.bbo(s, d).withColumns({"bid": S.text8(F.col("bid_px8")), "ask": S.text8(F.col("ask_px8")), "bq": S.text8(F.col("bid_qty8")), "aq": S.text8(F.col("ask_qty8")), "ms": F.expr("t0_ns div 1000000")})
    return b.select("ord", F.expr(text).alias("payload"))


@query("parse_binance_bbo", _PARSED.format(seq="sequence"))
def parse_binance_bbo(s, d):
    return parsers.binance_bbo(_ms_payload(s, d, """concat('{"u":', sequence, ',"s":"X","b":"', bid, '","B":"', bq, '","a":"', ask, '","A":"', aq, '","E":', ms, '}')""")).select(_QUOTE)


@query("parse_okx_bbo", _PARSED.format(seq="t0_ns // 1000000"))
def parse_okx_bbo(s, d):
    return parsers.okx_bbo(_ms_payload(s, d, """concat('{"arg":{"channel":"bbo"},"data":[{"bidPx":"', bid, '","bidSz":"', bq, '","askPx":"', ask, '","askSz":"', aq, '","ts":"', ms, '"}]}')""")).select(_QUOTE)


@query("parse_binance_trade", f"WITH {BBO} SELECT ord, ask_px8 AS price_px8, bid_qty8 AS size_qty8, t0_ns // 1000000 * 1000000 AS t0_ns, ord AS trade_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS side FROM bbo")
def parse_binance_trade(s, d):
    return parsers.binance_trade(_ms_payload(s, d, """concat('{"e":"trade","p":"', ask, '","q":"', bq, '","T":', ms, ',"t":', ord, ',"m":', if(k % 2 = 0, 'true', 'false'), '}')""")).select("ord", "price_px8", "size_qty8", "t0_ns", "trade_id", "side")


@query("parse_coinbase_bbo", f"WITH {BBO} SELECT ord, bid_px8, bid_qty8, ask_px8, ask_qty8, t0_ns, sequence, spread_bps FROM bbo")
def parse_coinbase_bbo(s, d):
    return parsers.coinbase_bbo(A.ticker_messages(s, d)).select(_QUOTE)


@query("parse_coinbase_trade", f"WITH {BBO} SELECT ord, ask_px8 AS price_px8, bid_qty8 AS size_qty8, sequence, ord + 1000 AS trade_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS side FROM bbo")
def parse_coinbase_trade(s, d):
    return parsers.coinbase_trade(A.ticker_messages(s, d)).select("ord", "price_px8", "size_qty8", "sequence", "trade_id", "side")


_KINDS = "CASE k % 5 WHEN 0 THEN '{{\"type\":\"heartbeat\",\"sequence\":' || {o} || ',\"last_trade_id\":7}}' WHEN 1 THEN 'not json' WHEN 2 THEN '{{\"type\":\"error\"}}' ELSE '{{\"type\":\"ticker\",\"product_id\":\"DOGE\"}}' END"


@query("message_type_route", f"WITH {BBO} SELECT CASE k % 5 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'malformed' WHEN 2 THEN 'error' ELSE 'ticker' END AS route, count(*) AS messages FROM bbo GROUP BY 1")
def message_type_route(s, d):
    m = parsers.message_fields(A.bbo(s, d).select("ord", F.expr(_KINDS.format(o="ord")).alias("payload")))
    return m.groupBy(F.coalesce("type", F.lit("malformed")).alias("route")).agg(F.count("*").alias("messages"))


@query("parse_client_command", f"WITH {BBO} SELECT ord, CASE k % 4 WHEN 0 THEN 'subscribe' WHEN 1 THEN 'unsubscribe' WHEN 2 THEN 'ping' END AS action, CASE k % 4 WHEN 0 THEN 72057594037927936 + market_id * 4294967296 + 16777216 + flags WHEN 1 THEN 72057594037927936 + market_id * 4294967296 + 16777216 END AS topic_key FROM bbo")
def parse_client_command(s, d):
    text = """CASE k % 4 WHEN 2 THEN '{"action":"ping"}' WHEN 3 THEN '{}' ELSE concat('{"action": "', if(k % 4 = 0, 'subscribe', 'unsubscribe'), '","venue":1,"market_id":', market_id, ',"stream_type":1,"flags":', flags, '}') END"""
    return parsers.client_command(A.bbo(s, d).select("ord", F.expr(text).alias("payload"))).select("ord", "action", "topic_key")


@query("quarantine_counts", f"WITH {BBO} SELECT k % 7 <> 0 AS ok, count(*) AS messages FROM bbo GROUP BY 1")
def quarantine_counts(s, d):
    broken = A.ticker_messages(s, d).withColumn("payload", F.when(F.col("k") % 7 == 0, F.regexp_replace("payload", "best_ask_size", "x")).otherwise(F.col("payload")))
    return parsers.coinbase_bbo(broken).groupBy("ok").agg(F.count("*").alias("messages"))


@query("quarantine_of_bad_numbers", f"WITH {BBO} SELECT k % 6 NOT IN (2, 3) AS ok, count(*) AS messages, sum(CASE WHEN k % 6 IN (0, 1) THEN CASE k % 6 WHEN 0 THEN 0 ELSE 1500000000 END END)::BIGINT AS bids FROM bbo GROUP BY 1")
def quarantine_of_bad_numbers(s, d):
    """Bids of no digits or an exponent are read by their digits; numbers and spreads beyond 64 bits go to quarantine."""
    bid = F.expr("CASE k % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '1e5' WHEN 2 THEN '99999999999999999999' WHEN 3 THEN '0.00000001' END")
    ask = F.when(F.col("k") % 6 == 3, "90000000000")
    b = A.ticker_messages(s, d).withColumns({"bid": bid, "ask": ask})
    said = lambda name, c, text: F.when(c.isNull(), text).otherwise(F.regexp_replace(text, F.lit(f'"{name}":"[^"]*"'), F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))))
    read = parsers.coinbase_bbo(b.withColumn("payload", said("best_ask", F.col("ask"), said("best_bid", F.col("bid"), F.col("payload")))))
    return read.groupBy("ok").agg(F.count("*").alias("messages"), F.sum(F.when(F.col("k") % 6 < 2, F.col("bid_px8"))).alias("bids"))


@query("raydium_quotes", f"WITH {BBO} SELECT ord, bid_px8 * 100 AS bid_px8, bid_px8 * 100 + bid_px8 * 100 * 5 // 10000 AS ask_px8, true AS ok FROM bbo")
def raydium_quotes(s, d):
    data = F.expr("concat(unhex(repeat('00', 16)), reverse_bytes, unhex(repeat('00', 40)))")
    rev = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("bid_px8"), 16, "0"), i, 2) for i in range(15, 0, -2))))
    return parsers.raydium_account(A.bbo(s, d).withColumn("reverse_bytes", rev).select("ord", data.alias("data"), F.lit(1).cast("long").alias("slot"))).select("ord", "bid_px8", "ask_px8", "ok")


# filters

@query("spread_filter", f"WITH {BBO} SELECT ord, spread_bps FROM bbo WHERE NOT (k % 20 > 0 AND spread_bps > k % 20)")
def spread_filter(s, d):
    limit = F.col("k") % 20
    return A.bbo(s, d).filter(~((limit > 0) & (F.col("spread_bps") > limit))).select("ord", "spread_bps")


@query("notional_filter", f"WITH {TRADES} SELECT trade_id FROM trades WHERE price_px8::DOUBLE / 1e8 * (size_qty8::DOUBLE / 1e8) >= 50000")
def notional_filter(s, d):
    return A.trades(s, d).filter(F.expr("CAST(price_px8 AS DOUBLE) / 1e8D * (CAST(size_qty8 AS DOUBLE) / 1e8D) >= 50000")).select("trade_id")


@query("mempool_filter", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity::BIGINT >= l_suppkey % 30 GROUP BY 1")
def mempool_filter(s, d):
    return A.read(s, d, "lineitem").filter("CAST(l_quantity AS BIGINT) >= l_suppkey % 30").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


_HEALTH = "CASE WHEN k % 3 = 0 THEN k % 2 = 0 OR now - ping <= 500 ELSE now - pong <= 500 END"


@query("heartbeat_health", f"WITH {BBO}, h AS (SELECT ord, k, ord % 1000 + 1000 AS now, CASE WHEN k % 2 = 0 THEN 0 ELSE ord % 700 + 1 END AS ping, CASE WHEN k % 3 = 0 THEN 0 ELSE ord % 900 + 1 END AS pong FROM bbo) SELECT ord, {_HEALTH} AS healthy FROM h")
def heartbeat_health(s, d):
    h = A.bbo(s, d).selectExpr("ord", "ord % 1000 + 1000 AS now", "CASE WHEN k % 2 = 0 THEN 0 ELSE ord % 700 + 1 END AS ping", "CASE WHEN k % 3 = 0 THEN 0 ELSE ord % 900 + 1 END AS pong")
    return h.selectExpr("ord", "CASE WHEN pong = 0 THEN ping = 0 OR now - ping <= 500 ELSE now - pong <= 500 END AS healthy")


# routing

def _judged(s, d):
    return router.verdicts(router.fan_out(A.bbo(s, d).select("ord", "venue", "market_id", "flags", "spread_bps"), A.subscriptions(s, d), 1), A.clients(s, d), 1)


@query("subscription_join", f"WITH {BBO}, {CLIENTS}, {MATCHED} SELECT verdict, count(*) AS pairs, count(DISTINCT client_id) AS clients FROM j GROUP BY verdict")
def subscription_join(s, d):
    return _judged(s, d).groupBy("verdict").agg(F.count("*").alias("pairs"), F.countDistinct("client_id").alias("clients"))


def _json(fields: list[tuple[str, str, bool]]) -> str:
    return " || ',' || ".join(f"'\"{n}\":' || " + (f"'\"' || {TEXT8(c)} || '\"'" if q else f"({c})::VARCHAR") for n, c, q in fields)


_TEL = "',\"telemetry\":{\"t0\":' || t0_ns || ',\"t1\":' || t1_ns || ',\"t2\":' || t2_ns || ',\"t3\":' || t3_ns || '}}'"
_BBO_TEXT = "'{\"type\":\"bbo\",' || " + _json([("market_id", "market_id", False), ("venue", "venue", False), ("chain", "chain", False), ("sequence", "sequence", False), ("bid_px", "bid_px8", True), ("bid_qty", "bid_qty8", True), ("ask_px", "ask_px8", True), ("ask_qty", "ask_qty8", True), ("spread_bps", "spread_bps", False), ("flags", "flags", False)]) + f" || {_TEL}"
_TRADE_TEXT = "'{\"type\":\"trade\",' || " + _json([("market_id", "market_id", False), ("venue", "venue", False), ("chain", "chain", False), ("sequence", "sequence", False), ("trade_id", "trade_id", False), ("price", "price_px8", True), ("size", "size_qty8", True), ("side", "side", False), ("is_liquidation", "is_liquidation", False)]) + f" || {_TEL}"
_STAMPED = f"{TRADES}, t AS (SELECT *, 0 AS chain, ord * 1000 AS t0_ns, ord * 1000 + 1 AS t1_ns, ord * 1000 + 2 AS t2_ns, ord * 1000 + 3 AS t3_ns FROM trades)"
# What goes to whom: of quotes and of trades, with the bytes of each message.
_SENT_BBO = f"{BBO}, {CLIENTS}, {MATCHED}, x AS (SELECT ord, length({_BBO_TEXT}) AS n FROM bbo), p AS (SELECT j.ord, client_id, protocol, verdict, CASE protocol WHEN 'sbe' THEN 92 ELSE n END AS bytes, j.ord * 3 AS now_ms FROM j JOIN x ON x.ord = j.ord)"
_SENT_TRADES = f"""{_STAMPED}, {CLIENTS}, n AS (SELECT *, length({_TRADE_TEXT}) AS n FROM t), p AS (SELECT t.ord, client_id, protocol, CASE WHEN state IS NULL OR state NOT IN (1, 2) THEN 'inactive' WHEN price_px8::DOUBLE / 1e8 * (size_qty8::DOUBLE / 1e8) < min_notional_usd THEN 'filtered' ELSE 'candidate' END AS verdict,
  CASE protocol WHEN 'sbe' THEN 95 ELSE n END AS bytes, t.ord * 3 AS now_ms FROM n t JOIN subs ON subs.stream = 3 AND subs.venue = t.venue AND subs.market_id = t.market_id LEFT JOIN clients USING (client_id))"""


def _limited(rate: int, burst: int) -> str:
    """The token bucket as a fold over each client's candidates of p: q has p's rows with delivered, filtered, rate_limited and inactive."""
    new = f"(CASE WHEN x.now > s.at THEN (x.now - s.at) * {rate} // 1000 ELSE 0 END)"
    have = f"(CASE WHEN {new} > 0 THEN least(s.tok + {new}, {burst}) ELSE s.tok END)"
    then = f"(CASE WHEN {new} > 0 THEN CASE WHEN {have} >= {burst} THEN x.now ELSE least(s.at + {new} * 1000 // {rate}, x.now) END ELSE s.at END)"
    return f"""k0 AS (SELECT client_id, list({{'now': now_ms, 'ord': ord}} ORDER BY now_ms, ord) AS l FROM p WHERE verdict = 'candidate' GROUP BY client_id),
k1 AS (SELECT client_id, l, list_reduce(l, lambda s, x: CASE WHEN {have} >= 1 THEN {{'at': {then}, 'tok': {have} - 1, 'ok': list_append(s.ok, true)}} ELSE {{'at': s.at, 'tok': s.tok, 'ok': list_append(s.ok, false)}} END, {{'at': l[1].now, 'tok': {burst}::BIGINT, 'ok': []::BOOLEAN[]}}).ok AS ok FROM k0),
k2 AS (SELECT client_id, unnest(l).ord AS ord, unnest(ok) AS ok FROM k1),
q AS (SELECT p.* EXCLUDE (verdict), CASE WHEN verdict <> 'candidate' THEN verdict WHEN ok THEN 'delivered' ELSE 'rate_limited' END AS verdict FROM p LEFT JOIN k2 ON p.ord = k2.ord AND p.client_id = k2.client_id)"""


_UNLIMITED = "q AS (SELECT * EXCLUDE (verdict), CASE verdict WHEN 'candidate' THEN 'delivered' ELSE verdict END AS verdict FROM p)"
_SIX = """SELECT ord, count(*) AS matched, count(*) FILTER (verdict = 'delivered') AS delivered, count(*) FILTER (verdict = 'filtered') AS filtered, count(*) FILTER (verdict = 'rate_limited') AS rate_limited,
  coalesce(sum(bytes) FILTER (verdict = 'delivered' AND protocol = 'sbe'), 0)::BIGINT AS sbe_bytes, coalesce(sum(bytes) FILTER (verdict = 'delivered' AND protocol = 'json'), 0)::BIGINT AS json_bytes FROM q GROUP BY ord"""
_BY_CLIENT = "SELECT client_id, count(*) FILTER (verdict = 'delivered') AS messages_sent, coalesce(sum(bytes) FILTER (verdict = 'delivered'), 0)::BIGINT AS bytes_sent, count(*) FILTER (verdict = 'rate_limited') AS dropped_rate_limit FROM q WHERE verdict IN ('delivered', 'rate_limited') GROUP BY client_id"


def _quotes_sent(s, d, *limit: int) -> DataFrame:
    return router.dispatch(A.bbo(s, d).withColumn("now_ms", F.col("ord") * 3), A.subscriptions(s, d), A.clients(s, d), 1, *limit)


def _trades_sent(s, d, *limit: int) -> DataFrame:
    return router.dispatch(_stamped(s, d).withColumn("now_ms", F.col("ord") * 3), A.subscriptions(s, d), A.clients(s, d), 3, *limit)


@query("dispatch_metrics_unlimited", f"WITH {_SENT_BBO}, {_UNLIMITED} {_SIX}")
def dispatch_metrics_unlimited(s, d):
    return router.metrics(_quotes_sent(s, d))


@query("dispatch_metrics", f"WITH {_SENT_BBO}, {_limited(5, 3)} {_SIX}")
def dispatch_metrics(s, d):
    return router.metrics(_quotes_sent(s, d, 5, 3))


@query("client_delivery_counts", f"WITH {_SENT_BBO}, {_limited(5, 3)} {_BY_CLIENT}")
def client_delivery_counts(s, d):
    return router.client_counts(_quotes_sent(s, d, 5, 3))


@query("trade_dispatch_metrics", f"WITH {_SENT_TRADES}, {_limited(4, 2)} {_SIX}")
def trade_dispatch_metrics(s, d):
    return router.metrics(_trades_sent(s, d, 4, 2))


@query("trade_client_counts", f"WITH {_SENT_TRADES}, {_UNLIMITED} {_BY_CLIENT}")
def trade_client_counts(s, d):
    return router.client_counts(_trades_sent(s, d))


@query("broadcast_frames", f"WITH {_SENT_BBO}, {_UNLIMITED} SELECT ord, count(*) AS frames, sum(CASE protocol WHEN 'sbe' THEN 94 WHEN 'json' THEN bytes + CASE WHEN bytes < 126 THEN 2 ELSE 4 END END)::BIGINT AS bytes FROM q WHERE verdict = 'delivered' GROUP BY ord")
def broadcast_frames(s, d):
    frames = websocket.broadcast(A.bbo(s, d), _quotes_sent(s, d), 1)
    return frames.groupBy("ord").agg(F.count("*").alias("frames"), F.sum(F.octet_length("frame")).cast("bigint").alias("bytes"))


@query("trade_subscription_join", f"WITH {TRADES}, {CLIENTS} SELECT trades.market_id, count(*) AS pairs, count(*) FILTER (state IN (1, 2) AND NOT price_px8::DOUBLE / 1e8 * (size_qty8::DOUBLE / 1e8) < min_notional_usd) AS delivered FROM trades JOIN subs ON subs.stream = 3 AND subs.venue = trades.venue AND subs.market_id = trades.market_id LEFT JOIN clients USING (client_id) GROUP BY 1")
def trade_subscription_join(s, d):
    judged = router.verdicts(router.fan_out(A.trades(s, d), A.subscriptions(s, d), 3), A.clients(s, d), 3)
    return judged.groupBy("market_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "candidate").alias("delivered"))


@query("topic_client_counts", f"WITH {CLIENTS} SELECT count(DISTINCT client_id) AS clients, count(DISTINCT (venue, market_id, stream, flags)) AS topics FROM subs")
def topic_client_counts(s, d):
    return A.subscriptions(s, d).agg(F.countDistinct("client_id").alias("clients"), F.countDistinct("topic_key").alias("topics"))


@query("token_bucket", f"WITH {_SENT_BBO}, {_limited(5, 3)} SELECT client_id, count(*) FILTER (verdict = 'delivered') AS delivered, count(*) FILTER (verdict = 'rate_limited') AS limited FROM q WHERE verdict IN ('delivered', 'rate_limited') GROUP BY client_id")
def token_bucket(s, d):
    ready = _judged(s, d).filter("verdict = 'candidate'").select("client_id", "ord", (F.col("ord") * 3).alias("now_ms"))
    return router.rate_limited(ready, 5, 3).groupBy("client_id").agg(F.count_if("delivered").alias("delivered"), F.count_if(~F.col("delivered")).alias("limited"))


_COMMANDS = "c AS (SELECT o_orderkey AS ord, o_custkey % 1100 AS client_id, o_custkey % 4 + (o_orderkey // 8 % 3) * 10 AS topic_key, ['register', 'subscribe', 'subscribe', 'unsubscribe', 'subscribe', 'register', 'subscribe', 'unregister'][hash_of % 8 + 1] AS kind FROM (SELECT *, o_orderkey * 7919 // 13 AS hash_of FROM orders)), l AS (SELECT *, last_value(CASE WHEN kind IN ('register', 'unregister') THEN kind END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c), e AS (SELECT *, CASE WHEN kind = 'register' AND was = 'register' THEN 'already exists' WHEN kind IN ('unregister', 'subscribe') AND (was IS NULL OR was = 'unregister') THEN 'not found' END AS error FROM l)"


def _commands(s, d) -> DataFrame:
    kinds = F.array(*map(F.lit, ["register", "subscribe", "subscribe", "unsubscribe", "subscribe", "register", "subscribe", "unregister"]))
    return A.read(s, d, "orders").selectExpr("o_orderkey AS ord", "o_custkey % 1100 AS client_id", "o_custkey % 4 + (o_orderkey div 8 % 3) * 10 AS topic_key", "CAST(o_orderkey * 7919 div 13 % 8 AS INT) AS h").withColumn("kind", F.element_at(kinds, F.col("h") + 1)).drop("h")


@query("client_registry", f"WITH {_COMMANDS} SELECT ord, client_id, kind, error FROM e")
def client_registry(s, d):
    return router.registry(_commands(s, d)).select("ord", "client_id", "kind", "error")


@query("registered_subscriptions", f"WITH {_COMMANDS}, z AS (SELECT client_id, max(ord) AS z FROM e WHERE kind = 'unregister' AND error IS NULL GROUP BY 1), t AS (SELECT client_id, topic_key, arg_max(kind, ord) AS kind, max(ord) AS ord FROM e WHERE kind IN ('subscribe', 'unsubscribe') AND error IS NULL AND client_id < 1024 GROUP BY 1, 2) SELECT client_id, topic_key FROM t LEFT JOIN z USING (client_id) WHERE kind = 'subscribe' AND (z IS NULL OR ord > z)")
def registered_subscriptions(s, d):
    return router.subscribed(router.registry(_commands(s, d)))


@query("subscription_state", "WITH c AS (SELECT o_custkey AS client_id, o_custkey % 10 + (o_orderkey % 3) * 10 AS topic_key, arg_max(o_orderkey % 2, o_orderkey) AS a FROM orders WHERE o_custkey < 1024 GROUP BY 1, 2) SELECT client_id, topic_key FROM c WHERE a = 1")
def subscription_state(s, d):
    commands = A.read(s, d, "orders").selectExpr("o_orderkey AS ord", "o_custkey AS client_id", "o_custkey % 10 + (o_orderkey % 3) * 10 AS topic_key", "if(o_orderkey % 2 = 1, 'subscribe', 'unsubscribe') AS action")
    return router.current_subscriptions(commands)


# sets of client ids

_SETS = "a AS (SELECT c_nationkey AS topic, c_custkey AS id FROM customer WHERE c_custkey < 1024 AND c_custkey % 2 = 0), b AS (SELECT c_nationkey AS topic, c_custkey AS id FROM customer WHERE c_custkey < 1024 AND c_custkey % 3 = 0)"


def _sets(s, d) -> tuple[DataFrame, DataFrame]:
    c = A.read(s, d, "customer").filter("c_custkey < 1024").selectExpr("c_nationkey AS topic", "c_custkey AS id")
    return c.filter("id % 2 = 0"), c.filter("id % 3 = 0")


@query("client_set_union", f"WITH {_SETS} SELECT topic, count(DISTINCT id) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY topic")
def client_set_union(s, d):
    a, b = _sets(s, d)
    return a.unionByName(b).groupBy("topic").agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("id") + 1))).alias("n"))


@query("client_set_intersect", f"WITH {_SETS} SELECT topic, id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def client_set_intersect(s, d):
    a, b = _sets(s, d)
    return a.intersect(b)


@query("client_set_members", f"WITH {_SETS} SELECT topic, count(*) AS n, min(id) AS first, max(id) AS last FROM a GROUP BY topic")
def client_set_members(s, d):
    return _sets(s, d)[0].groupBy("topic").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


# books

_BASE = "mid // 400000000 * 400000000"
_UPDATES = f"{BBO}, u AS (SELECT market_id AS book, ord, bid_px8, bid_qty8, abs(bid_px8 - {_BASE}) // 100000 AS idx FROM bbo)"


@query("ladder_snapshot", f"WITH {_UPDATES} SELECT book, idx, arg_max(bid_px8, ord) AS px8, arg_max(bid_qty8, ord) AS qty8, max(ord) AS ord FROM u WHERE idx < 2048 GROUP BY book, idx")
def ladder_snapshot(s, d):
    u = A.bbo(s, d).selectExpr("market_id AS book", "ord", "bid_px8", "bid_qty8", "abs(bid_px8 - (bid_px8 + ask_px8) div 2 div 400000000 * 400000000) div 100000 AS idx").filter("idx < 2048")
    last = u.groupBy("book", "idx").agg(F.max(F.struct("ord", "bid_px8", "bid_qty8")).alias("l"))
    return last.select("book", "idx", F.col("l.bid_px8").alias("px8"), F.col("l.bid_qty8").alias("qty8"), F.col("l.ord").alias("ord"))


_RUNNING = "max(bid_px8) OVER w AS best_bid, min(ask_px8) OVER w AS best_ask FROM bbo WINDOW w AS (PARTITION BY market_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"


def _running(s, d) -> DataFrame:
    return ordered.running(A.bbo(s, d), ["market_id"], "ord", {"best_bid": ("max", "bid_px8"), "best_ask": ("min", "ask_px8")})


@query("running_bbo", f"WITH {BBO} SELECT ord, {_RUNNING}")
def running_bbo(s, d):
    return _running(s, d).select("ord", "best_bid", "best_ask")


@query("quote_rewrite", f"WITH {BBO} SELECT ord, bid_qty8, ask_qty8, spread_bps, {_RUNNING}")
def quote_rewrite(s, d):
    return _running(s, d).select("ord", "bid_qty8", "ask_qty8", "spread_bps", "best_bid", "best_ask")


def _ladder_updates(s, d) -> DataFrame:
    """Two updates an event of a book for each market and four units of price, around its middle; every fifth bid empties its slot, and prices repeat."""
    b = A.bbo(s, d).withColumn("band", F.expr("(bid_px8 + ask_px8) div 2 div 400000000"))
    b = b.selectExpr("market_id * 1000000 + band AS book_id", "ord", "band * 400000000 + 200000000 AS base_px8", "bid_px8 div 20000000 * 20000000 AS bid", "ask_px8 div 20000000 * 20000000 + 20000000 AS ask", "bid_qty8", "ask_qty8")
    return b.selectExpr("book_id", "ord", "base_px8", "inline(array(struct('bid' AS side, bid AS price_px8, if(ord % 5 = 0, 0L, bid_qty8) AS quantity), struct('ask' AS side, ask AS price_px8, if(ord % 7 = 0, 0L, ask_qty8) AS quantity)))")


@query("ladder_exact")
def ladder_exact(s, d):
    return folds.ladder(_ladder_updates(s, d))


# sessions

_LAG = "lag({c}) OVER (PARTITION BY market_id ORDER BY ord)"


@query("seq_regression", f"WITH {BBO}, x AS (SELECT ord, market_id, sequence * 7919 % 1009 AS s FROM bbo), l AS (SELECT *, {_LAG.format(c='s')} AS p FROM x) SELECT ord, p AS last, s AS got FROM l WHERE s <= p")
def seq_regression(s, d):
    x = ordered.neighbour(A.bbo(s, d).selectExpr("ord", "market_id", "sequence * 7919 % 1009 AS got"), ["market_id"], "ord", {"last": "got"})
    return x.filter("got <= last").select("ord", "last", "got")


@query("trade_id_gaps", f"WITH {TRADES}, l AS (SELECT *, {_LAG.format(c='trade_id')} + 1 AS expected FROM trades) SELECT market_id, expected, trade_id AS got FROM l WHERE trade_id <> expected")
def trade_id_gaps(s, d):
    x = ordered.neighbour(A.trades(s, d), ["market_id"], "ord", {"last": "trade_id"}).withColumn("expected", F.col("last") + 1)
    return x.filter("trade_id <> expected").select("market_id", "expected", F.col("trade_id").alias("got"))


@query("trade_dedup", f"WITH {TRADES}, x AS (SELECT ord, market_id, trade_id * 7919 % 10007 + 1 AS tid FROM trades), m AS (SELECT *, coalesce(max(tid) OVER (PARTITION BY market_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM x) SELECT ord, tid FROM m WHERE tid > top")
def trade_dedup(s, d):
    x = ordered.running(A.trades(s, d).selectExpr("ord", "market_id", "trade_id * 7919 % 10007 + 1 AS tid"), ["market_id"], "ord", {"top": ("max", "tid")}, before=True)
    return x.filter("tid > coalesce(top, 0)").select("ord", "tid")


@query("stale_intervals", f"WITH {BBO}, l AS (SELECT market_id, ord, t1_ns, lead(t1_ns) OVER (PARTITION BY market_id ORDER BY ord) AS n FROM bbo) SELECT market_id, ord, n - t1_ns AS silent_ns FROM l WHERE n - t1_ns > 10000000000")
def stale_intervals(s, d):
    x = ordered.neighbour(A.bbo(s, d).select("market_id", "ord", "t1_ns"), ["market_id"], "ord", {"next": "t1_ns"}, after=True).withColumn("silent_ns", F.col("next") - F.col("t1_ns"))
    return x.filter("silent_ns > 10000000000").select("market_id", "ord", "silent_ns")


@query("reconnect_backoff", f"WITH {BBO}, x AS (SELECT ord, market_id, k % 3 = 0 AS heard FROM bbo), g AS (SELECT *, sum(heard::INT) OVER (PARTITION BY market_id ORDER BY ord) AS g FROM x), f AS (SELECT ord, row_number() OVER (PARTITION BY market_id, g ORDER BY ord) AS n FROM g WHERE NOT heard) SELECT ord, least(30, pow(2, least(n - 1, 5)))::INTEGER AS wait_s FROM f")
def reconnect_backoff(s, d):
    """Attempts of which one in three hears a message, and the wait after each of the others."""
    x = A.bbo(s, d).selectExpr("ord", "market_id", "CAST(k % 3 = 0 AS BIGINT) AS heard", "CAST(k % 3 <> 0 AS BIGINT) AS failed")
    x = ordered.running(x, ["market_id"], "ord", {"g": ("sum", "heard")})
    x = ordered.running(x, ["market_id", "g"], "ord", {"failures": ("sum", "failed")})
    return x.filter("failed = 1").select("ord", S.backoff_s(F.col("failures")).cast("int").alias("wait_s"))


_PRODUCTS = [f"M-{i}" for i in range(1, 9)]
# Messages of A.session_messages, their checks by windows, and what they count.
_FEED = """f AS (SELECT ord, market_id, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'error' WHEN k % 17 = 3 THEN 'subscriptions' WHEN k % 5 = 1 THEN 'heartbeat' ELSE 'ticker' END AS type, k % 19 <> 4 AS whole,
  ord // 3 * 3 + ord * 7919 % 4 AS seq, ord // 40 + ord * 31 % 3 AS tid FROM bbo),
v AS (SELECT * FROM f WHERE market_id <= 8 AND (type = 'heartbeat' OR type = 'ticker' AND whole)),
g1 AS (SELECT *, count(*) FILTER (type = 'ticker') OVER (PARTITION BY market_id ORDER BY ord) AS g FROM v),
g2 AS (SELECT *, CASE WHEN g > 0 THEN max(seq) OVER (PARTITION BY market_id, g ORDER BY ord) END AS top FROM g1),
g3 AS (SELECT *, lag(top) OVER w AS last, last_value(CASE type WHEN 'ticker' THEN tid END IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ours,
  coalesce(max(CASE type WHEN 'ticker' THEN tid END) OVER (PARTITION BY market_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS emitted FROM g2 WINDOW w AS (PARTITION BY market_id ORDER BY ord)),
a AS (SELECT *, CASE WHEN seq <= last THEN 'regression' WHEN type = 'ticker' AND tid <> ours + 1 THEN 'trade_gap' WHEN type = 'heartbeat' AND tid > ours THEN 'heartbeat_behind' END AS action FROM g3)"""


def _audited(s, d) -> DataFrame:
    return session.audit(session.read_messages(A.session_messages(s, d), _PRODUCTS).withColumn("connection", F.lit(0).cast("long")), ["connection", "product_id"])


@query("session_audit", f"WITH {BBO}, {_FEED} SELECT f.ord, coalesce(a.action, CASE f.type WHEN 'error' THEN 'error' END) AS action, CASE action WHEN 'regression' THEN last WHEN 'trade_gap' THEN ours + 1 WHEN 'heartbeat_behind' THEN ours END AS expected, CASE WHEN action = 'regression' THEN a.seq WHEN action IS NOT NULL THEN a.tid END AS got, coalesce(a.type = 'ticker', false) AS emits_quote, coalesce(a.type = 'ticker' AND a.tid > emitted, false) AS emits_trade FROM f LEFT JOIN a USING (ord)")
def session_audit(s, d):
    return _audited(s, d).select("ord", "action", "expected", "got", "emits_quote", "emits_trade")


@query("session_stats", f"""WITH {BBO}, {_FEED}, n AS (SELECT count(*) AS messages, count(*) FILTER (type = 'ticker') AS tickers, count(*) FILTER (type = 'heartbeat') AS heartbeats, count(*) FILTER (type IS NULL OR type = 'ticker' AND market_id <= 8 AND NOT whole) AS malformed,
  count(*) FILTER (type IN ('ticker', 'heartbeat') AND market_id > 8) AS unknown_product FROM f),
m AS (SELECT count(*) FILTER (type = 'ticker') + count(*) FILTER (type = 'ticker' AND tid > emitted) AS events_emitted, count(*) FILTER (action = 'regression') AS sequence_regressions, count(*) FILTER (action = 'trade_gap') AS trade_id_gaps, count(*) FILTER (action = 'heartbeat_behind') AS heartbeat_behind FROM a)
SELECT n.*, m.*, 0::BIGINT AS resubscribes, 0::BIGINT AS reconnects FROM n, m""")
def session_stats(s, d):
    return session.counters(_audited(s, d))


def _run(s, d) -> DataFrame:
    read = session.read_messages(A.session_messages(s, d), _PRODUCTS)
    return read.withColumn("connection", F.col("ord") % 3).withColumn("now_ms", F.expr("t1_ns div 1000000"))


@query("session_runner")
def session_runner(s, d):
    return folds.session(_run(s, d))


@query("session_runner_stats")
def session_runner_stats(s, d):
    read = _run(s, d)
    return session.counters(read.join(folds.session(read), ["connection", "ord"]), acted=True)


_TRACKED = """m AS (SELECT market_id, list({'ord': ord, 'snap': k % 50 = 0, 'a': ord * 2, 'b': ord * 2 + 40 + k} ORDER BY ord) AS l FROM bbo GROUP BY market_id),
t AS (SELECT market_id, list_reduce(l, lambda s, x: CASE WHEN x.snap THEN {'last': x.b, 'status': 'in_sync', 'gaps': s.gaps, 'o': list_append(s.o, {'ok': true, 'status': 'in_sync', 'expected': NULL::BIGINT, 'gaps': s.gaps})}
  WHEN s.status = 'synchronizing' THEN {'last': s.last, 'status': s.status, 'gaps': s.gaps, 'o': list_append(s.o, {'ok': false, 'status': s.status, 'expected': s.last + 1, 'gaps': s.gaps})}
  WHEN x.a <= s.last + 1 AND s.last + 1 <= x.b THEN {'last': x.b, 'status': s.status, 'gaps': s.gaps, 'o': list_append(s.o, {'ok': true, 'status': s.status, 'expected': s.last + 1, 'gaps': s.gaps})}
  WHEN x.b > s.last THEN {'last': s.last, 'status': 'gap', 'gaps': s.gaps + 1, 'o': list_append(s.o, {'ok': false, 'status': 'gap', 'expected': s.last + 1, 'gaps': s.gaps + 1})}
  ELSE {'last': s.last, 'status': s.status, 'gaps': s.gaps, 'o': list_append(s.o, {'ok': false, 'status': s.status, 'expected': s.last + 1, 'gaps': s.gaps})} END,
  {'last': 0::BIGINT, 'status': 'synchronizing', 'gaps': 0::BIGINT, 'o': []::STRUCT(ok BOOLEAN, status VARCHAR, expected BIGINT, gaps BIGINT)[]}).o AS o, l FROM m),
u AS (SELECT market_id, unnest(l).ord AS ord, unnest(o) AS o FROM t)"""


@query("sequence_tracker", f"WITH {BBO}, {_TRACKED} SELECT market_id, ord, o.ok AS accepted, o.status AS status, o.expected AS expected, o.gaps AS gaps FROM u")
def sequence_tracker(s, d):
    m = A.bbo(s, d).selectExpr("market_id", "ord", "if(k % 50 = 0, 'snapshot', 'delta') AS kind", "ord * 2 AS first_seq", "ord * 2 + 40 + k AS final_seq")
    return folds.sequence_tracker(m)


# rings and queues

@query("ring_read", f"WITH {BBO}, r AS (SELECT market_id, ord, row_number() OVER (PARTITION BY market_id ORDER BY ord) AS seq, count(*) OVER (PARTITION BY market_id) AS head FROM bbo) SELECT market_id, ord, seq, greatest(head - 64, 0) AS missed FROM r WHERE seq > head - 64")
def ring_read(s, d):
    held = rings.content(A.bbo(s, d).select("market_id", "ord"))
    return held.select("market_id", "ord", F.col("seq").cast("bigint").alias("seq"), F.expr("greatest(head - 64, 0L)").alias("missed"))


_HELD = "r AS (SELECT market_id, ord, row_number() OVER (PARTITION BY market_id ORDER BY ord) AS seq FROM bbo), h AS (SELECT market_id, max(seq) AS head FROM r GROUP BY 1), x AS (SELECT c_custkey AS reader, c_custkey % 11 + 1 AS market_id, coalesce(head, 0) AS head, CASE WHEN c_custkey % 5 = 0 THEN coalesce(head, 0) ELSE c_custkey * 13 % 150 END AS cursor FROM customer LEFT JOIN h ON c_custkey % 11 + 1 = h.market_id), y AS (SELECT *, CASE WHEN cursor >= head THEN 'empty' WHEN head > cursor + 64 THEN 'overrun' ELSE 'ok' END AS status FROM x)"


@query("ring_cursor_reads", f"WITH {BBO}, {_HELD} SELECT reader, status, CASE status WHEN 'overrun' THEN y.head - cursor - 64 ELSE 0 END AS missed, CASE status WHEN 'ok' THEN cursor + 1 WHEN 'overrun' THEN y.head - 64 ELSE cursor END AS next, r.ord AS ord FROM y LEFT JOIN r ON status = 'ok' AND r.market_id = y.market_id AND r.seq = cursor + 1")
def ring_cursor_reads(s, d):
    readers = A.read(s, d, "customer").selectExpr("c_custkey AS reader", "c_custkey % 11 + 1 AS market_id", "if(c_custkey % 5 = 0, NULL, c_custkey * 13 % 150) AS cursor")
    return rings.reads(readers, rings.content(A.bbo(s, d).select("market_id", "ord"))).select("reader", "status", F.col("missed").cast("bigint").alias("missed"), F.col("next").cast("bigint").alias("next"), "ord")


@query("queue_drop_newest", f"WITH {BBO} SELECT market_id, ord FROM bbo QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY ord) <= 32")
def queue_drop_newest(s, d):
    return folds.bounded_queue(A.bbo(s, d).select("market_id", "ord"), ["market_id"], "ord", 32, False)


@query("queue_drop_oldest", f"WITH {BBO} SELECT market_id, ord FROM bbo QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY ord DESC) <= 32")
def queue_drop_oldest(s, d):
    return folds.bounded_queue(A.bbo(s, d).select("market_id", "ord"), ["market_id"], "ord", 32, True)


@query("queue_counters", f"WITH {BBO}, n AS (SELECT market_id AS queue, count(*) AS n FROM bbo GROUP BY 1) SELECT queue, policy, least(n, 32) AS enqueued, CASE policy WHEN 'drop_newest' THEN greatest(n - 32, 0) ELSE 0 END AS dropped, CASE policy WHEN 'drop_oldest' THEN greatest(n - 32, 0) ELSE 0 END AS evicted, 0::BIGINT AS consumed, greatest(n - 32, 0) AS saturations FROM n, (VALUES ('drop_newest'), ('drop_oldest')) p(policy)")
def queue_counters(s, d):
    ops = A.bbo(s, d).select(F.col("market_id").alias("queue"), "ord", F.lit("push").alias("op"))
    return folds.queue_counters(folds.queue(ops, 32, False)).withColumn("policy", F.lit("drop_newest")).unionByName(folds.queue_counters(folds.queue(ops, 32, True)).withColumn("policy", F.lit("drop_oldest")))


@query("queue_with_pops")
def queue_with_pops(s, d):
    ops = A.bbo(s, d).selectExpr("market_id AS queue", "ord", "if(ord * 7919 % 10 < 3, 'pop', 'push') AS op")
    return folds.queue(ops, 8, True)


@query("rx_ring", "WITH r AS (SELECT event_type AS source, length(repeat(props, 1 + event_id % 300)) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) SELECT source, count(*) FILTER (i <= 512) AS packets, sum(least(n, 2048)) FILTER (i <= 512)::BIGINT AS bytes, count(*) FILTER (i <= 512 AND n > 2048) AS cut, count(*) FILTER (i > 512) AS dma_errors FROM r GROUP BY source")
def rx_ring(s, d):
    packets = A.read(s, d, "events").selectExpr("event_type AS source", "event_id AS ord", "repeat(props, CAST(1 + event_id % 300 AS INT)) AS payload")
    return rings.receive_counters(packets, "source", "ord", "payload")


@query("websocket_commands", f"WITH {BBO} SELECT ord, CASE k % 6 WHEN 0 THEN 'ping' WHEN 1 THEN 'disconnect' WHEN 5 THEN 'pong' WHEN 4 THEN 'ping' ELSE 'subscribe' END AS event, CASE WHEN k % 6 IN (2, 3) AND ord % 50 >= 25 THEN 'not found' END AS error, CASE k % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 4 THEN 23 + length(ord::VARCHAR) WHEN 5 THEN NULL ELSE CASE WHEN ord % 50 < 25 THEN 32 + length((72057594037927936 + market_id * 4294967296 + 16777216 + flags)::VARCHAR) END END::INTEGER AS bytes FROM bbo")
def websocket_commands(s, d):
    """Masked frames of clients, of which half are registered, and the bytes of what each is answered."""
    from ..operators.codec import frame, unmasked

    def masked(row: dict) -> list[tuple]:
        opcode, body = {0: (9, b"hi"), 1: (8, b""), 5: (10, b""), 4: (1, b'{"action":"ping"}')}.get(row["k"] % 6, (1, f'{{"action":"subscribe","venue":1,"market_id":{row["market_id"]},"stream_type":1,"flags":{row["flags"]}}}'.encode()))
        mask, sent = (row["ord"] * 7919).to_bytes(8, "big")[-4:], frame(opcode, body)
        return [(row["ord"] % 50, row["ord"], row["ord"], sent[:1] + bytes([sent[1] | 128]) + mask + unmasked(body, mask))]

    frames = amm.mapped(A.bbo(s, d).select("ord", "k", "market_id", "flags"), "client_id long, ord long, now_ms long, data binary", masked)
    answered = websocket.answers(frames, s.range(25).withColumnRenamed("id", "client_id"))
    return answered.select("ord", "event", "error", F.octet_length("response").alias("bytes"))


# encoders and signals

@query("trade_quote_qty", f"WITH {TRADES} SELECT trade_id, (CASE WHEN price_px8 > 0 THEN price_px8::HUGEINT * size_qty8 // 100000000 ELSE 0 END)::BIGINT AS quote_qty8 FROM trades")
def trade_quote_qty(s, d):
    return A.trades(s, d).select("trade_id", F.expr("if(price_px8 > 0, CAST(price_px8 AS DECIMAL(19,0)) * CAST(size_qty8 AS DECIMAL(19,0)) div 100000000, 0L)").alias("quote_qty8"))


@query("bbo_json", f"WITH {BBO} SELECT ord, {_BBO_TEXT} AS json FROM bbo")
def bbo_json(s, d):
    return A.bbo(s, d).select("ord", codec.quote_json().alias("json"))


def _stamped(s, d) -> DataFrame:
    return A.trades(s, d).withColumn("chain", F.lit(0)).withColumns({f"t{i}_ns": F.col("ord") * 1000 + i for i in range(4)})


@query("trade_json", f"WITH {_STAMPED} SELECT ord, {_TRADE_TEXT} AS json FROM t")
def trade_json(s, d):
    return _stamped(s, d).select("ord", codec.trade_json().alias("json"))


@query("sbe_quote_roundtrip", f"WITH {BBO} SELECT ord, venue::BIGINT AS venue, market_id, sequence, bid_px8, bid_qty8, ask_px8, ask_qty8, spread_bps::BIGINT AS spread_bps, t3_ns, 92 AS bytes FROM bbo")
def sbe_quote_roundtrip(s, d):
    names = ["venue", "market_id", "sequence", "bid_px8", "bid_qty8", "ask_px8", "ask_qty8", "spread_bps", "t3_ns"]
    back = codec.decode(codec.encode(A.bbo(s, d).select("ord", *codec.QUOTE_FIELDS), 1).select("ord", "sbe"), 1)
    return back.select("ord", *(F.col("message").getField(n).alias(n) for n in names), F.octet_length("sbe").alias("bytes"))


@query("sbe_trade_roundtrip", f"WITH {TRADES} SELECT ord, trade_id, price_px8, size_qty8, side::BIGINT AS side, is_liquidation, 95 AS bytes, (CASE WHEN price_px8 > 0 THEN price_px8::HUGEINT * size_qty8 // 100000000 ELSE 0 END)::BIGINT AS quote_qty8 FROM trades")
def sbe_trade_roundtrip(s, d):
    back = codec.decode(codec.encode(_stamped(s, d).select("ord", *codec.TRADE_FIELDS[:12], "is_liquidation"), 3).select("ord", "sbe"), 3)
    quote = F.conv(F.concat(*(F.hex(F.substring("sbe", i, 1)) for i in range(89, 81, -1))), 16, 10).cast("bigint")
    return back.select("ord", *(F.col("message").getField(n).alias(n) for n in ("trade_id", "price_px8", "size_qty8", "side", "is_liquidation")), F.octet_length("sbe").alias("bytes"), quote.alias("quote_qty8"))


@query("ws_frame_roundtrip", "SELECT event_id, props, octet_length(encode(props)) + 2 AS bytes FROM events")
def ws_frame_roundtrip(s, d):
    sent = A.read(s, d, "events").select("event_id", codec.framed(1, F.encode("props", "UTF-8")).alias("data"))
    return codec.opened(sent).select("event_id", F.decode("body", "UTF-8").alias("props"), F.octet_length("data").cast("bigint").alias("bytes"))


@query("cross_venue_arb", f"WITH {BBO}, q AS (SELECT t0_ns // 60000000000 AS minute, market_id, venue, max(bid_px8) AS bid, min(ask_px8) AS ask FROM bbo GROUP BY 1, 2, 3) SELECT a.minute, a.market_id, a.venue AS sell, b.venue AS buy, (a.bid - b.ask) * 10000 // b.ask AS bps FROM q a JOIN q b ON a.minute = b.minute AND a.market_id = b.market_id AND a.venue <> b.venue AND a.bid > b.ask")
def cross_venue_arb(s, d):
    q = A.bbo(s, d).groupBy(F.expr("t0_ns div 60000000000").alias("minute"), "market_id", "venue").agg(F.max("bid_px8").alias("bid"), F.min("ask_px8").alias("ask"))
    b = q.select("minute", "market_id", F.col("venue").alias("buy"), F.col("ask").alias("buy_ask"))
    hit = q.join(b, ["minute", "market_id"]).filter("venue <> buy AND bid > buy_ask")  # at most a row a venue on each side
    return hit.select("minute", "market_id", F.col("venue").alias("sell"), "buy", F.expr("(bid - buy_ask) * 10000 div nullif(buy_ask, 0)").alias("bps"))


@query("burst_windows", f"WITH {BBO} SELECT t0_ns // 3600000000000 AS hour, count(*) AS ticks FROM bbo GROUP BY 1 HAVING count(*) >= 5")
def burst_windows(s, d):
    return A.bbo(s, d).groupBy(F.expr("t0_ns div 3600000000000").alias("hour")).agg(F.count("*").alias("ticks")).filter("ticks >= 5")


# pools

def _pools(s, d) -> DataFrame:
    return A.read(s, d, "part").selectExpr("p_partkey AS pool", "p_size", "CAST(round(p_retailprice * 100) AS BIGINT) AS cents")


_RESERVES = "p AS (SELECT p_partkey AS pool, (p_size + 1)::HUGEINT * 1000000000000000000 AS rb, round(p_retailprice * 100)::HUGEINT * 10000 * (p_size + 1) AS rq FROM part), sp AS (SELECT *, rq * 1000000000000 * 100000000 // rb AS spot FROM p)"


def _reserves(row: dict) -> tuple[int, int]:
    return (row["p_size"] + 1) * 10**18, row["cents"] * 10_000 * (row["p_size"] + 1)


@query("v2_spot", f"WITH {_RESERVES} SELECT pool, spot::BIGINT AS spot_px8 FROM sp")
def v2_spot(s, d):
    reserves = _pools(s, d).selectExpr("pool", "CAST(p_size + 1 AS DECIMAL(18,0)) * CAST(1000000000000000000 AS DECIMAL(19,0)) AS rb", "CAST(cents * 10000 * (p_size + 1) AS DECIMAL(18,0)) AS rq")
    return reserves.select("pool", amm.v2_spot_column(F.col("rb"), F.col("rq")).alias("spot_px8"))


@query("sqrt_spot", "WITH p AS (SELECT p_partkey AS pool, (p_partkey * 7919 % 1000003)::HUGEINT AS x FROM part) SELECT pool, ((x * x * 68719476736 // 4294967296 * 68719476736 * 100000000 + 9223372036854775808) // 18446744073709551616)::BIGINT AS spot_px8 FROM p")
def sqrt_spot(s, d):
    """Of concentrated-liquidity pools of either version, by the square root of the price in 96 bits."""
    pools = A.read(s, d, "part").selectExpr("p_partkey AS pool", "p_partkey * 7919 % 1000003 AS x")
    return amm.mapped(pools, "pool long, spot_px8 long", lambda r: [(r["pool"], amm.sqrt_spot(r["x"] << 84))])


_FLAGS = "p_partkey * 7919 % 65536"


@query("hook_flags", f"SELECT p_partkey AS pool, ({_FLAGS})::INTEGER AS flags, " + ", ".join(f"({_FLAGS}) & {1 << i} <> 0 AS {n}" for i, n in enumerate(S.HOOKS)) + ", p_size % 3 = 0 AS dynamic_fee FROM part")
def hook_flags(s, d):
    pools = A.read(s, d, "part").select(F.col("p_partkey").alias("pool"), F.unhex(F.concat(F.lpad(F.hex(F.expr(_FLAGS)), 4, "0"), F.repeat(F.lit("AB"), 18))).alias("hooks"), F.when(F.col("p_size") % 3 == 0, 0x800000).otherwise(500).alias("fee"))
    return pools.select("pool", S.hook_flags(F.col("hooks")).alias("flags"), *(S.has_hook(F.col("hooks"), n).alias(n) for n in S.HOOKS), S.has_dynamic_fee(F.col("fee")).alias("dynamic_fee"))


@query("v2_book")
def v2_book(s, d):
    from decimal import Decimal

    return amm.mapped(_pools(s, d), amm.LEVELS, lambda r: [(r["pool"], side, i, px, Decimal(q), amm.slot_of(px, amm.v2_spot(*_reserves(r)))) for side, i, px, q in amm.v2_levels(*_reserves(r), [10, 25, 50, 100])])


_TICKS = [(90, -5_000_000_000), (100, 10_000_000_000), (110, -5_000_000_000)]


def _levels(s, d, fee: bool) -> DataFrame:
    from decimal import Decimal

    def of(r: dict) -> list[tuple]:
        spot = r["cents"] * 10**6
        bps = amm.v4_fee(0x800000 if r["p_size"] % 3 == 0 else 500, 12 if r["p_size"] % 2 else None, -2, True) if fee else None
        return [(r["pool"], side, i, px, Decimal(q), amm.slot_of(px, spot)) for side, i, px, q in amm.tick_levels(spot, 100, 50_000_000_000_000 * (r["p_size"] + 1), _TICKS, bps)]

    return amm.mapped(_pools(s, d), amm.LEVELS, of)


@query("clmm_book")
def clmm_book(s, d):
    return _levels(s, d, False)


@query("v4_book")
def v4_book(s, d):
    return _levels(s, d, True)


@query("v4_fee", "SELECT p_partkey AS pool, greatest(0, least(10000, CASE WHEN p_size % 3 = 0 THEN coalesce(CASE WHEN p_size % 2 = 1 THEN 12 END, 30) ELSE 5 END - 2))::INTEGER AS fee_bps FROM part")
def v4_fee(s, d):
    fee, override = F.when(F.col("p_size") % 3 == 0, 0x800000).otherwise(500), F.when(F.col("p_size") % 2 == 1, 12)
    base = F.when(fee.bitwiseAND(0x800000) != 0, F.coalesce(override, F.lit(30))).otherwise((fee / 100).cast("int"))
    return _pools(s, d).select("pool", F.greatest(F.lit(0), F.least(F.lit(10_000), base - 2)).cast("int").alias("fee_bps"))


@query("curve_book")
def curve_book(s, d):
    from decimal import Decimal

    def of(r: dict) -> list[tuple]:
        raw, dec = [(r["p_size"] + 1) * 10**11, (r["p_size"] + 2) * 10**11], [6, 6]
        spot, out = amm.curve_spot(0, 1, raw, dec, 50, 4), []
        for i, bps in enumerate((1, 2, 5, 10)):
            dy = amm.curve_out(0, 1, raw[0] * bps // 10_000, raw, dec, 50, 4)
            for side, px in (("ask", spot + spot * bps // 10_000), ("bid", spot - spot * bps // 10_000)):
                out.append((r["pool"], side, i, px, Decimal(dy * 10**12 * 10**8 // 10**18), amm.slot_of(px, spot)))
        return out

    return amm.mapped(_pools(s, d), amm.LEVELS, of)


@query("mempool_impact", f"""WITH {_RESERVES},
t AS (SELECT l_partkey AS pool, l_returnflag = 'A' AS buy, l_quantity::BIGINT::HUGEINT * 1000000 AS a FROM lineitem),
x AS (SELECT pool, spot, rb, rq, buy, a, CASE WHEN buy THEN a * 9970 * rb // (rq * 10000 + a * 9970) ELSE a * 9970 * rq // (rb * 10000 + a * 9970) END AS o FROM t JOIN sp USING (pool)),
n AS (SELECT pool, spot, CASE WHEN buy THEN CASE WHEN rb > o THEN rb - o ELSE rb END ELSE CASE WHEN rq > o THEN rb + a ELSE rb END END AS nb, CASE WHEN buy THEN CASE WHEN rb > o THEN rq + a ELSE rq END ELSE CASE WHEN rq > o THEN rq - o ELSE rq END END AS nq FROM x),
f AS (SELECT pool, spot, nq * 1000000000000 * 100000000 // nb AS after FROM n)
SELECT pool, count(*) AS swaps, max((abs(after - spot) * 10000 // spot) & 65535)::BIGINT AS worst_bps FROM f GROUP BY pool""")
def mempool_impact(s, d):
    txs = A.read(s, d, "lineitem").selectExpr("l_partkey AS pool", "l_returnflag = 'A' AS buy", "CAST(l_quantity AS BIGINT) * 1000000 AS amount")
    joined = txs.join(_pools(s, d), "pool")

    def of(r: dict) -> list[tuple]:
        hit = amm.swap_impact(*_reserves(r), 30, r["buy"], r["amount"])
        return [(r["pool"], hit[2])] if hit else []

    return amm.mapped(joined, "pool long, bps long", of).groupBy("pool").agg(F.count("*").alias("swaps"), F.max("bps").alias("worst_bps"))


@query("sim_feed")
def sim_feed(s, d):
    s.dataSource.register(simulator.FeedSource)
    return s.read.format(simulator.FeedSource.name()).option("seed", 1337).option("events", 1000).load()
