"""Web-socket clients: their frames as commands with answers, and messages to them as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec, parsers, router

# Opcodes, and the most bytes of a ping's payload that fit in the answer's buffer.
TEXT, BINARY, CLOSE, PING, PONG, MOST_PING = 1, 2, 8, 9, 10, 252


def answers(frames: DataFrame, registered: DataFrame) -> DataFrame:
    """Frames (client_id, ord, now_ms, data) with event, topic_key, error and the binary `response`.

    A ping is answered by a pong of the same payload, a close by a close (and the client is gone), a subscription of a `registered` client by an
    acknowledgement, of another by the error `not found`, a JSON ping by a JSON pong. Other frames and texts have no answer.
    """
    read = codec.opened(frames).withColumn("payload", F.when(F.col("opcode") == TEXT, F.decode("body", "UTF-8")))
    known = registered.select("client_id").distinct().withColumn("__ws_known", F.lit(True))
    read = parsers.client_command(read).join(router.small(known), "client_id", "left")
    op, text = F.col("opcode"), lambda *parts: codec.framed(TEXT, F.encode(F.concat(*parts), "UTF-8"))
    asked = (op == TEXT) & (F.col("action") == "subscribe")
    topic = F.conv(F.hex("topic_key"), 16, 10)  # as an unsigned number
    unknown = asked & F.col("__ws_known").isNull()
    event = F.when(op == PING, "ping").when(op == PONG, "pong").when(op == CLOSE, "disconnect").when(op == TEXT, F.coalesce("action", F.lit("ignored"))).when(op.isNotNull(), "ignored")
    response = (
        F.when((op == PING) & (F.length("body") <= MOST_PING), codec.framed(PONG, F.col("body"))).when(op == CLOSE, codec.framed(CLOSE, F.lit(b"")))
        .when(asked & ~unknown & F.col("topic_key").isNotNull(), text(F.lit('{"type":"subscribed","topic":'), topic, F.lit("}")))
        .when((op == TEXT) & (F.col("action") == "ping"), text(F.lit('{"type":"pong","ts":'), F.col("now_ms").cast("string"), F.lit("}")))
    )
    error = F.when(unknown, "not found").when((op == PING) & (F.length("body") > MOST_PING), "buffer too small").otherwise(F.col("error"))
    return read.select("client_id", "ord", event.alias("event"), "topic_key", error.alias("error"), response.alias("response"))


def commands(answered: DataFrame) -> DataFrame:
    """What `router.registry` reads: subscriptions, unsubscriptions and ends of clients."""
    kind = F.when(F.col("event") == "disconnect", "unregister").otherwise(F.col("event"))
    return answered.filter("event in ('subscribe', 'unsubscribe', 'disconnect')").select("client_id", "ord", kind.alias("kind"), "topic_key")


def broadcast(events: DataFrame, dispatched: DataFrame, stream: int) -> DataFrame:
    """(ord, client_id, frame) of each delivery: a binary frame of the packed message, or a text frame of the JSON; each is made once an event."""
    text = codec.quote_json() if stream == 1 else codec.trade_json()
    made = codec.encode(events.withColumn("__ws_json", F.encode(text, "UTF-8")), stream, "__ws_sbe")
    made = made.select("ord", codec.framed(BINARY, F.col("__ws_sbe")).alias("sbe"), codec.framed(TEXT, F.col("__ws_json")).alias("json"))
    sent = dispatched.filter("verdict = 'delivered'").select("ord", "client_id", "protocol").join(made, "ord")
    return sent.select("ord", "client_id", F.when(F.col("protocol") == "sbe", F.col("sbe")).otherwise(F.col("json")).alias("frame"))
