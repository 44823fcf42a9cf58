"""Streams driven to completion over a table, for the driver's row check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.runtime import shared_folder, table
from tidemark.streaming import replay


def stream_replay_maturity(spark, d):
    """Events replayed as a stream: forecasts made from revealed prefixes, then joined to their targets."""
    s = series.trajectories(table(spark, d, "events"), "user_id", "ts", "event_id", "value")
    s = s.select("unit", "event_index", F.col("ts").cast("timestamp").alias("at"), "value")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s.write.parquet(f"{base}/events")
    events = spark.readStream.schema(s.schema).parquet(f"{base}/events")
    q = replay.commit_batches(replay.forecasts(events), f"{base}/predictions", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.parquet(f"{base}/predictions").drop("batch")
    labels = spark.read.parquet(f"{base}/events").select("unit", F.col("event_index").alias("target_index"), F.col("value").alias("actual"))
    j = made.join(labels, ["unit", "target_index"], "left")
    return j.select("unit", "origin", "target_index", (F.round("point", 9) + F.lit(0.0)).alias("point"), "actual", F.when(F.col("actual").isNull(), "NEVER_MATURED").otherwise("MATURED").alias("status"))


QUERIES = {"stream_replay_maturity": stream_replay_maturity}

ORACLE = {
    "stream_replay_maturity": """with ev as (select user_id as unit, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events),
w as (select unit, i, value, first_value(value) over (partition by unit order by i rows between 7 preceding and current row) as v0, least(i + 1, 8) as n, lead(value) over (partition by unit order by i) as actual from ev)
select unit, i as origin, i + 1 as target_index, round(value + (value - v0) / (n - 1), 9) + 0.0::double as point, actual, case when actual is null then 'NEVER_MATURED' else 'MATURED' end as status from w where i >= 3""",
}
