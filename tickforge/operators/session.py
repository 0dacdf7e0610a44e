"""A feed session over recorded messages: checks, actions and its eleven counters.

Audit: no action is taken, so a product's state is a window over its rows. Runner (`folds.session`): an action clears the baselines of all
products of its connection, so a connection is one ordered fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, parsers

#: What a session counts.
COUNTERS = ["messages", "tickers", "heartbeats", "events_emitted", "malformed", "unknown_product", "sequence_regressions", "trade_id_gaps", "heartbeat_behind", "resubscribes", "reconnects"]


def read_messages(messages: DataFrame, products: list[str]) -> DataFrame:
    """`messages` with type, product_id, market_id (place in `products`, from 1; null if unknown), sequence, trade_id, the quote's and the trade's
    fields, and `valid`: a ticker with a whole quote and trade, or a heartbeat with both numbers, of a known product."""
    known = messages.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(products)], "product_id string, market_id int")
    quote = parsers.coinbase_bbo(messages).withColumnRenamed("ok", "quote_ok").drop("sequence", "venue", "t0_ns")
    trade = parsers.coinbase_trade(quote).withColumnRenamed("ok", "trade_ok").drop("sequence", "trade_id", "venue")
    fields = parsers.message_fields(trade).drop("market_id").join(F.broadcast(known), "product_id", "left")  # as many rows as products
    seen = F.col("sequence").isNotNull() & F.col("trade_id").isNotNull() & F.col("market_id").isNotNull()
    whole = F.when(F.col("type") == "ticker", F.col("quote_ok") & F.col("trade_ok")).otherwise(F.col("type") == "heartbeat")
    return fields.withColumn("valid", F.coalesce(seen & whole, F.lit(False)))


def audit(read: DataFrame, keys: list[str], order: str = "ord", span: int = ordered.SPAN) -> DataFrame:
    """Rows of `read_messages` with action, expected, got, emits_quote and emits_trade; `keys` name a product of a connection."""
    ticker = F.col("type") == "ticker"
    rows = read.filter("valid").withColumns({"__ss_range": F.expr(f"CAST(floor(`{order}` / {span}) AS BIGINT)"), "__ss_tid": F.when(ticker, F.col("trade_id"))})
    here = Window.partitionBy(*keys, "__ss_range").orderBy(order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    # Within a range: its tickers so far, and the last sequence, which a ticker sets and heartbeats raise.
    x = rows.withColumn("__ss_group", F.sum(ticker.cast("long")).over(here))
    x = x.withColumn("__ss_top", F.max("sequence").over(Window.partitionBy(*keys, "__ss_range", "__ss_group").orderBy(order)))
    # Over a product's ranges: what stands at the end of each, and so at the start of the next.
    ends = x.groupBy(*keys, "__ss_range").agg(F.max("__ss_group").alias("n"), F.max_by("__ss_top", order).alias("top"), F.max_by("__ss_tid", F.when(F.col("__ss_tid").isNotNull(), F.col(order))).alias("tid"), F.max("__ss_tid").alias("most"))
    upto = Window.partitionBy(*keys).orderBy("__ss_range")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("set", F.sum("n").over(upto))
    ends = ends.withColumn("last", F.when(F.col("set") > 0, F.max("top").over(Window.partitionBy(*keys, "set").orderBy("__ss_range"))))
    carry = ends.select(*keys, "__ss_range", F.lag("last").over(upto).alias("__ss_last"), F.last("tid", ignorenulls=True).over(earlier).alias("__ss_carried"), F.max("most").over(earlier).alias("__ss_most"))
    x = x.join(carry, [*keys, "__ss_range"])
    x = x.withColumns({"__ss_since": F.lag("__ss_group").over(here), "__ss_held": F.lag("__ss_top").over(here), "__ss_own": F.last("__ss_tid", ignorenulls=True).over(before), "__ss_max": F.max("__ss_tid").over(before)})
    x = x.withColumn("__ss_before", F.when(F.col("__ss_since") > 0, F.col("__ss_held")).when(F.col("__ss_last").isNotNull(), F.greatest("__ss_last", "__ss_held")))
    x = x.withColumns({"__ss_ours": F.coalesce("__ss_own", "__ss_carried"), "__ss_emitted": F.greatest("__ss_max", "__ss_most")})
    regressed = F.col("sequence") <= F.col("__ss_before")
    gap = ticker & (F.col("trade_id") != F.col("__ss_ours") + 1)
    behind = ~ticker & (F.col("trade_id") > F.col("__ss_ours"))
    action = F.when(regressed, "regression").when(gap, "trade_gap").when(behind, "heartbeat_behind")
    x = x.withColumn("action", action)
    x = x.withColumn("expected", F.when(regressed, F.col("__ss_before")).when(gap, F.col("__ss_ours") + 1).when(behind, F.col("__ss_ours")))
    x = x.withColumn("got", F.when(regressed, F.col("sequence")).when(gap | behind, F.col("trade_id")))
    emitted = ticker & (F.col("trade_id") > F.coalesce("__ss_emitted", F.lit(0)))
    x = x.withColumns({"emits_quote": ticker, "emits_trade": emitted}).drop(*(c for c in x.columns if c.startswith("__ss_")))
    rest = read.filter("not valid").withColumns({"action": F.when(F.col("type") == "error", "error"), "expected": F.lit(None).cast("bigint"), "got": F.lit(None).cast("bigint"), "emits_quote": F.lit(False), "emits_trade": F.lit(False)})
    return x.unionByName(rest)


def counters(judged: DataFrame, acted: bool = False) -> DataFrame:
    """One row of COUNTERS; resubscribes and reconnects are counted where a runner has `acted`."""
    kind, n = F.col("type"), F.count_if
    ticker, heartbeat = kind == "ticker", kind == "heartbeat"
    nameless = (ticker | heartbeat) & F.col("product_id").isNull()
    known = F.col("market_id").isNotNull()
    again = F.col("action").isin("regression", "trade_gap", "heartbeat_behind")
    return judged.agg(
        F.count("*").alias("messages"), n(ticker).alias("tickers"), n(heartbeat).alias("heartbeats"), (n("emits_quote") + n("emits_trade")).alias("events_emitted"),
        n(kind.isNull() | nameless | (ticker & known & ~F.col("valid"))).alias("malformed"), n((ticker | heartbeat) & F.col("product_id").isNotNull() & ~known).alias("unknown_product"),
        n(F.col("action") == "regression").alias("sequence_regressions"), n(F.col("action") == "trade_gap").alias("trade_id_gaps"), n(F.col("action") == "heartbeat_behind").alias("heartbeat_behind"),
        (n(again) if acted else F.lit(0).cast("bigint")).alias("resubscribes"), (n(F.col("action").isin("error", "stale")) if acted else F.lit(0).cast("bigint")).alias("reconnects"),
    )
