"""Structured Streaming forms of the market operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import router


def run(quotes: DataFrame, subscriptions: DataFrame, clients: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Delivery counts of each quote, appended to `out`: every micro-batch runs the batch plan, so both give the same rows."""

    def batch(rows: DataFrame, number: int) -> None:
        router.metrics(router.dispatch(rows, subscriptions, clients, 1)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    writer = quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sequence_regressions(quotes: DataFrame) -> DataFrame:
    """(market_id, last, got) of quotes whose sequence is not above the last of their market, across micro-batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ord")
        bad = []
        for got in rows["sequence"]:
            if last is not None and got <= last:
                bad.append((key[0], last, int(got)))
            last = int(got)
        state.update((last,))
        yield pd.DataFrame(bad, columns=["market_id", "last", "got"])

    return quotes.groupBy("market_id").applyInPandasWithState(step, "market_id long, last long, got long", "last long", "update", GroupStateTimeout.NoTimeout)
