"""Routing to subscribers: an inverted index as equi-joins, filters, and delivery counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import codec, ordered
from .folds import ordered_fold

#: Subscriptions and clients are broadcast up to this many rows (client ids in the index are below 1024 a shard); beyond, Spark shuffles.
MOST_BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def fan_out(events: DataFrame, subscriptions: DataFrame, stream: int) -> DataFrame:
    """Each event with each client of its topics, once: quotes (stream 1) match their flags or flags 0, trades (3) flags 0."""
    keys = F.array(S.topic_key(F.col("venue"), F.col("market_id"), stream, 0))
    if stream == 1:
        keys = F.array_distinct(F.array(S.topic_key(F.col("venue"), F.col("market_id"), 1, F.col("flags")), keys[0]))
    hit = events.withColumn("topic_key", F.explode(keys)).join(small(subscriptions.distinct()), "topic_key").drop("topic_key")
    return hit.dropDuplicates(["ord", "client_id"]) if stream == 1 else hit


def verdicts(matched: DataFrame, clients: DataFrame, stream: int) -> DataFrame:
    """Matched rows with a verdict: inactive (or no such client), filtered, candidate."""
    out = matched.join(small(clients), "client_id", "left")
    notional = F.col("price_px8").cast("double") / 1e8 * (F.col("size_qty8").cast("double") / 1e8) if stream == 3 else None
    refused = ((F.col("max_spread_bps") > 0) & (F.col("spread_bps") > F.col("max_spread_bps"))) if stream == 1 else notional < F.col("min_notional_usd")
    return out.withColumn("verdict", F.when(~F.coalesce(F.col("state").isin(1, 2), F.lit(False)), "inactive").when(refused, "filtered").otherwise("candidate"))


def dispatch(events: DataFrame, subscriptions: DataFrame, clients: DataFrame, stream: int, rate: int | None = None, burst: int | None = None) -> DataFrame:
    """(ord, client_id, protocol, verdict, bytes) of each event with each client of its topics.

    Verdicts: inactive, filtered, rate_limited, too_long (a JSON text over its buffer), delivered; `bytes` are those of the message in the
    client's protocol. A token is taken by candidates only, and by texts that are too long as well. Without `rate` there is no limit.
    """
    text = codec.quote_json() if stream == 1 else codec.trade_json()
    used = ["flags", "spread_bps"] if stream == 1 else ["price_px8", "size_qty8"]
    sent = events.select("ord", "venue", "market_id", *used, F.octet_length(text).alias("json_bytes"), *(["now_ms"] if rate is not None else []))
    judged = verdicts(fan_out(sent, subscriptions, stream), clients, stream)
    size = F.when(F.col("protocol") == "sbe", codec.SIZES[stream]).otherwise(F.col("json_bytes"))
    judged = judged.select("ord", "client_id", "protocol", "verdict", size.cast("long").alias("bytes"), *(["now_ms"] if rate is not None else []))
    if rate is not None:
        limited = rate_limited(judged.filter("verdict = 'candidate'"), rate, burst)
        limited = limited.select("ord", "client_id", "protocol", F.when(F.col("delivered"), "candidate").otherwise("rate_limited").alias("verdict"), "bytes")
        judged = judged.filter("verdict <> 'candidate'").drop("now_ms").unionByName(limited)
    fits = (F.col("protocol") == "sbe") | (F.col("bytes") <= codec.MOST_JSON)
    return judged.withColumn("verdict", F.when(F.col("verdict") != "candidate", F.col("verdict")).when(fits, "delivered").otherwise("too_long"))


def metrics(dispatched: DataFrame) -> DataFrame:
    """Counts by event: matched, delivered, filtered, rate_limited, and the bytes sent by protocol."""
    sent = lambda protocol: F.coalesce(F.sum(F.when((F.col("verdict") == "delivered") & (F.col("protocol") == protocol), F.col("bytes"))), F.lit(0)).cast("bigint")
    count = lambda verdict: F.count_if(F.col("verdict") == verdict)
    return dispatched.groupBy("ord").agg(F.count("*").alias("matched"), count("delivered").alias("delivered"), count("filtered").alias("filtered"), count("rate_limited").alias("rate_limited"), sent("sbe").alias("sbe_bytes"), sent("json").alias("json_bytes"))


def client_counts(dispatched: DataFrame) -> DataFrame:
    """Of each client that anything was sent to or held back from: messages_sent, bytes_sent, dropped_rate_limit."""
    sent = F.col("verdict") == "delivered"
    some = dispatched.filter(F.col("verdict").isin("delivered", "rate_limited"))
    return some.groupBy("client_id").agg(F.count_if(sent).alias("messages_sent"), F.coalesce(F.sum(F.when(sent, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_sent"), F.count_if(~sent).alias("dropped_rate_limit"))


def registry(commands: DataFrame) -> DataFrame:
    """`commands` (client_id, ord, kind, topic_key) with `error`: register of a known client, unregister or subscribe of an unknown one; unsubscribe always goes."""
    told = commands.withColumn("__rg_state", F.when(F.col("kind").isin("register", "unregister"), F.col("kind")))
    seen = ordered.last_known(told, ["client_id"], "ord", {"__rg_last": "__rg_state"})
    here, kind = F.coalesce(F.col("__rg_last") == "register", F.lit(False)), F.col("kind")
    error = F.when((kind == "register") & here, "already exists").when(kind.isin("unregister", "subscribe") & ~here, "not found")
    return seen.withColumn("error", error).drop("__rg_state", "__rg_last")


def subscribed(judged: DataFrame) -> DataFrame:
    """(client_id, topic_key) that stand after all commands of `registry`: subscriptions without error that neither the topic's unsubscription nor the client's end followed; ids of 1024 and more are in no topic."""
    ends = judged.filter("kind = 'unregister' and error is null").groupBy("client_id").agg(F.max("ord").alias("__rg_end"))
    last = judged.filter("kind in ('subscribe', 'unsubscribe') and error is null and client_id < 1024").groupBy("client_id", "topic_key").agg(F.max_by("kind", "ord").alias("kind"), F.max("ord").alias("ord"))
    return last.join(ends, "client_id", "left").filter("kind = 'subscribe' and (__rg_end is null or ord > __rg_end)").select("client_id", "topic_key")


def rate_limited(candidates: DataFrame, rate: int, burst: int) -> DataFrame:
    """Candidates (client_id, now_ms, ord; protocol and bytes pass through where they are) with delivered, by a token bucket for each client."""
    more = [c for c in ("protocol", "bytes") if c in candidates.columns]

    def bucket(now: int, state: list | None) -> tuple[bool, list]:
        at, tokens = state or [now % (1 << 40), burst & 0xFFFFFF]
        have, then = tokens, at
        if now > at and (new := (now - at) * rate // 1000) > 0:
            have = min(tokens + new, burst)
            then = now if have >= burst else min(at + new * 1000 // rate, now)
        return (True, [then % (1 << 40), (have - 1) & 0xFFFFFF]) if have >= 1 else (False, [at, tokens])

    def step(row: dict, state: list | None) -> tuple[list[tuple], list]:
        ok, state = bucket(row["now_ms"], state)
        return [(row["client_id"], row["ord"], ok, *(row[c] for c in more))], state

    schema = "client_id long, ord long, delivered boolean" + "".join(f", {c} {'long' if c == 'bytes' else 'string'}" for c in more)
    return ordered_fold(candidates.select("client_id", "now_ms", "ord", *more), ["client_id"], ["now_ms", "ord"], step, schema)


def current_subscriptions(commands: DataFrame) -> DataFrame:
    """(client_id, topic_key) whose last command, by ord, is a subscription; ids of 1024 and more are refused."""
    last = commands.filter("client_id < 1024").groupBy("client_id", "topic_key").agg(F.max_by("action", "ord").alias("action"))
    return last.filter("action = 'subscribe'").select("client_id", "topic_key")


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
