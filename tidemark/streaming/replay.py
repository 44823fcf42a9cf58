"""Causal replay as streams.

Events arrive as a stream. Forecasts are made from what a unit has revealed so far by a
stateful operator that keeps a bounded prefix per unit; labels come when the target event
does, by a stream-stream join on unit and index with watermarks on availability, and
forecasts whose label never comes leave the join unmatched. Each micro-batch is written
and its checkpoint committed before the next is read, which is the commit barrier.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PREDICTIONS = "unit long, origin long, target_index long, made_at timestamp, point double"
STATE = "next_index long, last_values array<double>"
HELD, CHUNK = 1 << 20, 4096


def in_order(frames: Iterator[pd.DataFrame], by: str, held: int = HELD, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of all frames of a group, in order of ``by``; equal ones as they came.

    A large group comes in many frames with no order among them. Beyond ``held`` rows,
    sorted runs lie in a local file and are merged, so a group of any size fits.
    """

    def run(part: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(part, ignore_index=True).sort_values(by, kind="stable")

    def read(spots: list[int]) -> Iterator[tuple]:
        for at in spots:
            file.seek(at)
            yield from pickle.load(file).itertuples(index=False)

    with tempfile.TemporaryFile() as file:
        runs, part, n = [], [], 0
        for f in frames:
            part.append(f)
            n += len(f)
            if n >= held:
                whole, spots = run(part), []
                for k in range(0, n, chunk):
                    spots.append(file.tell())
                    pickle.dump(whole.iloc[k : k + chunk], file)
                runs.append(spots)
                part, n = [], 0
        rest = run(part).itertuples(index=False) if n else iter(())
        yield from heapq.merge(*map(read, runs), rest, key=attrgetter(by)) if runs else rest


def forecasts(events: DataFrame, horizon: int = 1, context: int = 4, kept: int = 8) -> DataFrame:
    """Drift forecasts of a stream ``unit, event_index, at, value`` from the last ``kept`` values of each unit.

    A unit's events of one micro-batch are put in order first. An event older than what the
    unit revealed in earlier ones is late and changes nothing: what was forecast stays as
    committed.
    """
    columns = ["unit", "origin", "target_index", "made_at", "point"]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, values = state.get if state.exists else (0, [])
        values = list(values)
        out = []
        for r in in_order(frames, "event_index"):
            if r.event_index < upto:
                continue
            values = [*values, r.value][-kept:]
            upto = r.event_index + 1
            if upto >= context:
                drift = (values[-1] - values[0]) / (len(values) - 1) if len(values) > 1 else 0.0
                out.append((key[0], r.event_index, r.event_index + horizon, r.at, values[-1] + horizon * drift))
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=columns)
                out = []
        state.update((upto, values))
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("unit").applyInPandasWithState(step, PREDICTIONS, STATE, "append", GroupStateTimeout.NoTimeout)


def matured(predictions: DataFrame, labels: DataFrame, patience: str = "7 days") -> DataFrame:
    """Forecasts with their labels; those without one within ``patience`` come out with status NEVER_MATURED."""
    p = predictions.withWatermark("made_at", patience)
    a = labels.select(F.col("unit").alias("l_unit"), F.col("event_index").alias("l_index"), F.col("at").alias("l_at"), F.col("value").alias("actual")).withWatermark("l_at", patience)
    within = (F.col("unit") == F.col("l_unit")) & (F.col("target_index") == F.col("l_index")) & (F.col("l_at") >= F.col("made_at")) & (F.col("l_at") <= F.col("made_at") + F.expr(f"interval {patience}"))
    j = p.join(a, within, "left_outer")
    return j.select("unit", "origin", "target_index", "point", "actual", F.when(F.col("l_unit").isNull(), "NEVER_MATURED").otherwise("MATURED").alias("status"))


def batch_forecasts(events: DataFrame, horizon: int = 1, context: int = 4, kept: int = 8) -> DataFrame:
    """The same forecasts over a finished table, as window expressions: what the stream must equal."""
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("event_index")
    last = w.rowsBetween(1 - kept, 0)
    n = F.count("*").over(last)
    drift = F.when(n > 1, (F.col("value") - F.first("value").over(last)) / (n - 1)).otherwise(0.0)
    return events.withColumn("point", F.col("value") + horizon * drift).filter(F.col("event_index") >= context - 1).select("unit", F.col("event_index").alias("origin"), (F.col("event_index") + horizon).alias("target_index"), "point")


def commit_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch to its own folder once; a batch that is run again replaces only itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running_counters(records: DataFrame) -> DataFrame:
    """Order counters of record streams per group with O(1) state: rows, repeats, reversals, gaps of record numbers.

    A group's records of one micro-batch are put in order of ``seq`` first.
    """
    schema = "grp long, n_rows long, repeats long, reversals long, gaps long"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, repeats, reversals, gaps, last = state.get if state.exists else (0, 0, 0, 0, None)
        for r in in_order(frames, "seq"):
            x = r.record_number
            if last is not None:
                repeats, reversals, gaps = repeats + (x == last), reversals + (x < last), gaps + (x > last + 1)
            last, n = int(x), n + 1
        state.update((int(n), int(repeats), int(reversals), int(gaps), last))
        yield pd.DataFrame([(key[0], n, repeats, reversals, gaps)], columns=["grp", "n_rows", "repeats", "reversals", "gaps"])

    return records.groupBy("grp").applyInPandasWithState(step, schema, "n long, repeats long, reversals long, gaps long, last long", "update", GroupStateTimeout.NoTimeout)
