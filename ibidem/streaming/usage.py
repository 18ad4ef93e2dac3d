"""Usage by key and month over a stream of events, with state of our own and timeouts.

For each key the state holds the counts of its open months. A batch adds its rows, whatever their order, to the months that they
belong to, and gives out the new total of each month that it touched, with whether a quota is exceeded. A key's state goes
once the watermark has passed the end of its last month; rows that are later than the watermark don't count, by contract.
Totals only grow, so a reader takes the greatest of each key and month, also where a batch was written twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OUT = "key string, month string, total long, exceeded boolean"


def totals(events: DataFrame, key: str, at: str = "ts", late: str = "60 days", quota: int | None = None) -> DataFrame:
    """key, month (as 2024-05), total, exceeded of every month that a batch touched; in update mode."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(group, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        months = dict(zip(*state.get, strict=True)) if state.exists else {}
        touched: set[str] = set()
        for rows in batches:
            for month, n in rows["month"].value_counts().items():
                months[month] = months.get(month, 0) + int(n)
                touched.add(month)
        kept = sorted(months)
        state.update((kept, [months[m] for m in kept]))
        last = pd.Timestamp(f"{kept[-1]}-01") + pd.DateOffset(months=1)
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        shown = sorted(touched)
        yield pd.DataFrame({"key": group[0], "month": shown, "total": [months[m] for m in shown], "exceeded": [quota is not None and months[m] > quota for m in shown]})

    named = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null")
    seen = named.withWatermark("at", late).withColumn("month", F.date_format("at", "yyyy-MM"))
    return seen.groupBy("key").applyInPandasWithState(count, OUT, "months array<string>, counts array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def keep_totals(events: DataFrame, target: str, checkpoint: str, key: str, **options) -> StreamingQuery:
    """Writes each batch's totals under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    out = totals(events, key, **options)
    return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame) -> DataFrame:
    """FLT7, AG28: the last total of each key and month."""
    return rows.groupBy("key", "month").agg(F.max("total").alias("total"), F.bool_or("exceeded").alias("exceeded"))
