"""Where streams end: a ring that readers follow, deliveries, and what a monitor asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import router, websocket


def publish(quotes: DataFrame, ring: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append quotes to the table of a ring: `rings.content` of it is what the ring holds. A repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{ring}/batch={number}")

    writer = quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deliver(quotes: DataFrame, subscriptions: DataFrame, clients: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Frames for each client, by batch, with a table of counts and the time from receipt to egress beside them."""

    def batch(rows: DataFrame, number: int) -> None:
        sent = router.dispatch(rows, subscriptions, clients, 1)
        websocket.broadcast(rows, sent, 1).write.mode("overwrite").parquet(f"{out}/frames/batch={number}")
        router.metrics(sent).join(rows.select("ord", (F.col("t2_ns") - F.col("t1_ns")).alias("process_ns")), "ord").write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    writer = quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def metrics_text(uptime_s: int, ticks: int, tier: int) -> str:
    """What a monitor scrapes."""
    rows = [("uptime_seconds", "Seconds since the start", "gauge", uptime_s), ("ticks_processed_total", "Messages processed", "counter", ticks), ("active_tier", "Tier of the transport (1, 2 or 3)", "gauge", tier)]
    return "".join(f"# HELP tickforge_{n} {h}\n# TYPE tickforge_{n} {k}\ntickforge_{n} {v}\n" for n, h, k, v in rows)


def health(path: str, queries: list[StreamingQuery], uptime_s: int, tier: int) -> tuple[int, str]:
    """(status, body) of /healthz (alive), /readyz (every stream runs) and /metrics (rows of all streams so far)."""
    if path == "/healthz":
        return 200, "OK"
    if path == "/readyz":
        return (200, "READY") if queries and all(q.isActive for q in queries) else (503, "NOT_READY")
    if path == "/metrics":
        return 200, metrics_text(uptime_s, sum(p["numInputRows"] for q in queries for p in q.recentProgress), tier)
    return 404, "NOT FOUND"
