"""Usage counters: out of order, over a restart, against a batch count."""

import random
from collections import Counter
from datetime import datetime, timedelta

from ibidem.streaming import usage as U
from ibidem.streaming.ingest import stream_of


def test_totals_over_a_restart(spark, tmp_path):
    rng = random.Random(8)
    began = datetime(2024, 3, 1)
    rows = [(f"k{rng.randint(0, 5)}", began + timedelta(hours=rng.randint(0, 24 * 75))) for _ in range(500)]
    rows.sort(key=lambda r: r[1] + timedelta(days=rng.randint(-20, 20)))  # out of order, by less than the watermark allows
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(4):
        few = rows[part * 125 : part * 125 + 125] + ([(None, began), ("k1", None)] if part == 0 else [])
        spark.createDataFrame(few, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        if part % 2:  # the query is started anew, from its checkpoint
            stream = stream_of(spark, source, "key string, ts timestamp")
            U.keep_totals(stream, target, checkpoint, "key", quota=40).awaitTermination()
    got = {(r.key, r.month): (r.total, r.exceeded) for r in U.current(spark.read.parquet(target)).collect()}
    want = Counter((k, at.strftime("%Y-%m")) for k, at in rows)
    assert got == {k: (n, n > 40) for k, n in want.items()}
    assert len({r.batch for r in spark.read.parquet(target).select("batch").distinct().collect()}) >= 2


def test_state_ends(spark, tmp_path):
    """Once the watermark has passed, a key's state goes; what is later than the watermark doesn't count."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([("a", datetime(2024, 1, 5))], [("b", datetime(2024, 8, 1))], [("b", datetime(2024, 8, 2))], [("a", datetime(2024, 1, 6)), ("a", datetime(2024, 8, 3))]):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        U.keep_totals(stream_of(spark, source, "key string, ts timestamp"), target, checkpoint, "key", late="10 days").awaitTermination()
    got = {(r.key, r.month): r.total for r in U.current(spark.read.parquet(target)).collect()}
    assert got == {("a", "2024-01"): 1, ("b", "2024-08"): 2, ("a", "2024-08"): 1}
