"""Order-dependent operators as folds: rows are dealt by key, sorted, and streamed, so a long key needs no more memory than a short one."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, Any], tuple[list[tuple], Any]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, end: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """step(row, state or None) gives output rows and the next state of the row's key; end(state) gives rows when a key ends."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if now is not None and end:
                        out += end(state)
                    now, state = key, None
                rows, state = step(row, state)
                out += rows
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in out], made)
                out = []
        if now is not None and end:
            out += end(state)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in out], made)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sequence_tracker(deltas: DataFrame) -> DataFrame:
    """(market_id, ord, accepted, status, expected) of rows (market_id, ord, kind, first_seq, final_seq)."""

    def step(row: dict, state: dict | None) -> tuple[list[tuple], dict]:
        s = state or {"last": 0, "status": "synchronizing", "gaps": 0}
        if row["kind"] == "snapshot":
            s |= {"last": row["final_seq"], "status": "in_sync"}
            return [(row["market_id"], row["ord"], True, s["status"], None, s["gaps"])], s
        expected, ok = s["last"] + 1, False
        if s["status"] != "synchronizing":
            if row["first_seq"] <= expected <= row["final_seq"]:
                s["last"], ok = row["final_seq"], True
            elif row["final_seq"] > s["last"]:
                s["status"], s["gaps"] = "gap", s["gaps"] + 1
        return [(row["market_id"], row["ord"], ok, s["status"], expected, s["gaps"])], s

    return ordered_fold(deltas, ["market_id"], ["ord"], step, "market_id long, ord long, accepted boolean, status string, expected long, gaps long")


def ladder(updates: DataFrame) -> DataFrame:
    """(book_id, ord, bid_px8, bid_qty8, ask_px8, ask_qty8) after each update (book_id, ord, base_px8, side, price_px8, quantity).

    2048 slots of 0.001 by distance from the base; a slot is overwritten; the best slot moves outward, or is searched anew when emptied.
    """

    def step(row: dict, state: dict | None) -> tuple[list[tuple], dict]:
        s = state or {"bid": {}, "ask": {}, "best": {"bid": 0, "ask": 2047}}
        side, price, qty = row["side"], row["price_px8"], row["quantity"]
        slot = abs(price - row["base_px8"]) // 100_000
        if slot < 2048:
            book, best = s[side], s["best"][side]
            book[slot] = (price, qty)
            held = book.get(best, (0, 0))
            better = price > held[0] if side == "bid" else price < held[0]
            if qty > 0 and (held[1] == 0 or better):
                s["best"][side] = slot
            elif qty == 0 and slot == best:
                full = [(p, i) for i, (p, q) in book.items() if q > 0 and p > 0]
                s["best"][side] = 0 if not full else min(full, key=lambda x: (-x[0] if side == "bid" else x[0], x[1]))[1]
        top = [x if (x := s[k].get(s["best"][k], (0, 0)))[1] > 0 else (None, None) for k in ("bid", "ask")]
        return [(row["book_id"], row["ord"], *top[0], *top[1])], s

    return ordered_fold(updates, ["book_id"], ["ord", "side"], step, "book_id long, ord long, bid_px8 long, bid_qty8 long, ask_px8 long, ask_qty8 long")


def session(messages: DataFrame, stale_ms: int = 10_000, reset: bool = True) -> DataFrame:
    """(connection, ord, action, expected, got, emits_quote, emits_trade) of rows (connection, ord, now_ms, type, product_id, sequence, trade_id, valid).

    With `reset` every action clears the baselines of all products of the connection, as a runner does; the largest emitted trade is kept.
    A silence of more than `stale_ms` before a message is an action too (`stale`), in the place of which the message's own comes only if it has one.
    Rows that are not `valid` (malformed, or of an unknown product) only end a silence.
    """

    def step(row: dict, state: dict | None) -> tuple[list[tuple], dict]:
        s = state or {"seq": {}, "tid": {}, "max": {}, "at": row["now_ms"]}
        action, expected, got, trade = None, None, None, False
        p, seq, tid = row["product_id"], row["sequence"], row["trade_id"]
        if row["now_ms"] - s["at"] > stale_ms:
            action = "stale"
            if reset:
                s["seq"], s["tid"] = {}, {}
        s["at"] = row["now_ms"]
        quote = row["type"] == "ticker" and row["valid"]
        if row["type"] == "error":
            action = "error"
        elif quote:
            if p in s["seq"] and seq <= s["seq"][p]:
                action, expected, got = "regression", s["seq"][p], seq
            elif p in s["tid"] and tid != s["tid"][p] + 1:
                action, expected, got = "trade_gap", s["tid"][p] + 1, tid
            s["seq"][p], s["tid"][p] = seq, tid
            if trade := tid > s["max"].get(p, 0):
                s["max"][p] = tid
        elif row["valid"]:
            if p in s["seq"] and seq <= s["seq"][p]:
                action, expected, got = "regression", s["seq"][p], seq
            else:
                if p in s["seq"]:
                    s["seq"][p] = seq
                if p in s["tid"] and tid > s["tid"][p]:
                    action, expected, got = "heartbeat_behind", s["tid"][p], tid
        if action and reset:
            s["seq"], s["tid"] = {}, {}
        return [(row["connection"], row["ord"], action, expected, got, quote, trade)], s

    cols = ["connection", "ord", "now_ms", "type", "product_id", "sequence", "trade_id", "valid"]
    return ordered_fold(messages.select(*cols), ["connection"], ["ord"], step, "connection long, ord long, action string, expected long, got long, emits_quote boolean, emits_trade boolean")


def queue(ops: DataFrame, capacity: int, drop_oldest: bool) -> DataFrame:
    """(queue, ord, result, item) of pushes and pops (queue, ord, op) in order: enqueued, dropped, evicted (then `item` went), popped or empty."""

    def step(row: dict, state: dict | None) -> tuple[list[tuple], dict]:
        s = state or {"held": deque()}
        held, item = s["held"], None
        if row["op"] == "pop":
            result, item = ("popped", held.popleft()) if held else ("empty", None)
        elif len(held) < capacity:
            result = "enqueued"
            held.append(row["ord"])
        elif drop_oldest:
            result, item = "evicted", held.popleft()
            held.append(row["ord"])
        else:
            result = "dropped"
        return [(row["queue"], row["ord"], result, item)], s

    return ordered_fold(ops.select("queue", "ord", "op"), ["queue"], ["ord"], step, "queue long, ord long, result string, item long")


def queue_counters(done: DataFrame) -> DataFrame:
    """Of each queue: enqueued (an eviction's item is not), dropped, evicted, consumed, saturations."""
    n = lambda *results: F.count_if(F.col("result").isin(*results))
    return done.groupBy("queue").agg(n("enqueued").alias("enqueued"), n("dropped").alias("dropped"), n("evicted").alias("evicted"), n("popped").alias("consumed"), n("dropped", "evicted").alias("saturations"))


def bounded_queue(df: DataFrame, keys: list[str], order: str, capacity: int, drop_oldest: bool) -> DataFrame:
    """What is in queues of this capacity after all pushes: the newest or the oldest rows. No pops in between."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(order) if drop_oldest else F.asc(order))
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= capacity).drop("__rank")
