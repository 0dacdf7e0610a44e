"""Market tables over the driver's Parquet tables; columns are pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and offer rows, one for each event."""
    e = read(spark, sf_dir, "events").selectExpr(
        "event_id AS ord", "event_id AS sequence", "user_id % 10 + 1 AS market_id",
        "CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'signup' THEN 102 ELSE 201 END AS INT) AS venue",
        "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS t0_ns", "CAST(round(value * 100) AS BIGINT) * 1000000 AS mid",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )
    e = e.selectExpr("*", "mid - mid * (k % 30 + 1) div 20000 AS bid_px8", "mid + mid * (k % 30 + 1) div 20000 AS ask_px8", "(k + 1) * 100000000 AS bid_qty8", "(100 - k) * 100000000 AS ask_qty8", "CAST(ord % 2 AS INT) AS flags")
    e = e.withColumn("t1_ns", F.expr("t0_ns + ord * 7919 % 3301 + 200"))
    e = e.withColumn("t2_ns", F.expr("t1_ns + ord * 104729 % 1001 + 500")).withColumn("t3_ns", F.expr("t2_ns + ord * 1299709 % 601 + 200"))
    return e.withColumn("spread_bps", S.spread_bps(F.col("bid_px8"), F.col("ask_px8"))).withColumn("chain", F.lit(0)).drop("mid")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade tape, one trade for each order."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ord", "o_orderkey AS trade_id", "o_orderkey AS sequence", "o_custkey % 10 + 1 AS market_id", "CAST(o_custkey % 2 + 1 AS INT) AS venue",
        "CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS price_px8", "(o_custkey % 7 + 1) * 10000000 AS size_qty8",
        "CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS side", "o_orderpriority = '1-URGENT' AS is_liquidation",
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS client_id", "CASE c_custkey % 2 WHEN 0 THEN 'sbe' ELSE 'json' END AS protocol", "CAST(c_custkey % 4 AS INT) AS state",
        "CAST(c_nationkey AS BIGINT) AS max_spread_bps", "greatest(c_acctbal, 0D) AS min_notional_usd",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_key, client_id) of the inverted index; client ids of 1024 and more are never in it."""
    c = read(spark, sf_dir, "customer").filter("c_custkey < 1024")
    venue = F.element_at(F.array(*map(F.lit, (1, 2, 4, 102, 201))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    made = c.select(F.col("c_custkey").alias("client_id"), venue.alias("venue"), (F.col("c_custkey") % 10 + 1).alias("market_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("stream"), (F.col("c_nationkey") % 2).alias("flags"))
    return made.select("client_id", S.topic_key(F.col("venue"), F.col("market_id"), F.col("stream"), F.when(F.col("stream") == 1, F.col("flags")).otherwise(0)).alias("topic_key"))


def ticker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticker payloads as an exchange would send them, with their arrival."""
    b = bbo(spark, sf_dir)
    quoted = lambda name, c: F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))
    payload = F.concat_ws(
        ",", F.concat(F.lit('{"type":"ticker","sequence":'), F.col("sequence").cast("string")), quoted("product_id", F.concat(F.lit("M-"), F.col("market_id").cast("string"))),
        quoted("price", S.text8(F.col("ask_px8"))), quoted("best_bid", S.text8(F.col("bid_px8"))), quoted("best_bid_size", S.text8(F.col("bid_qty8"))),
        quoted("best_ask", S.text8(F.col("ask_px8"))), quoted("best_ask_size", S.text8(F.col("ask_qty8"))), quoted("side", F.when(F.col("k") % 2 == 0, "sell").otherwise("buy")),
        quoted("time", F.concat(F.date_format(F.timestamp_micros(F.expr("t0_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.expr("t0_ns div 1000 % 1000000").cast("string"), 6, "0"), F.lit("Z"))),
        F.concat(F.lit('"trade_id":'), (F.col("ord") + 1000).cast("string")), F.concat(quoted("last_size", S.text8(F.col("bid_qty8"))), F.lit("}")),
    )
    return b.select("ord", "market_id", "t1_ns", "k", payload.alias("payload"))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recorded session holds: tickers, heartbeats, errors, acknowledgements, broken texts, and products that nobody asked for."""
    t = ticker_messages(spark, sf_dir).withColumns({"seq": F.expr("ord div 3 * 3 + ord * 7919 % 4").cast("string"), "tid": F.expr("ord div 40 + ord * 31 % 3").cast("string")})
    named = F.concat(F.lit('"product_id":"M-'), F.col("market_id").cast("string"), F.lit('"'))
    ticker = F.regexp_replace(F.regexp_replace("payload", F.lit('"sequence":[0-9]+'), F.concat(F.lit('"sequence":'), F.col("seq"))), F.lit('"trade_id":[0-9]+'), F.concat(F.lit('"trade_id":'), F.col("tid")))
    ticker = F.when(F.col("k") % 19 == 4, F.regexp_replace(ticker, "best_ask_size", "best_ask_sizes")).otherwise(ticker)
    heartbeat = F.concat(F.lit('{"type":"heartbeat","sequence":'), F.col("seq"), F.lit(',"last_trade_id":'), F.col("tid"), F.lit(","), named, F.lit("}"))
    text = F.when(F.col("k") % 13 == 0, "not json").when(F.col("k") % 11 == 0, '{"type":"error","message":"no"}').when(F.col("k") % 17 == 3, '{"type":"subscriptions","channels":[]}').when(F.col("k") % 5 == 1, heartbeat).otherwise(ticker)
    return t.select("ord", "t1_ns", text.alias("payload"))
