"""Attributes as known at event time, under two clocks.

A change has a place in its entity's order (``place``) and a time from which it is known
(``known``). An event may use changes up to a place (``bound``) that are known at its own
time (``at``); of these the one with the greatest place counts, then the latest known,
then the greatest id.

Changes and events of one entity are united, sorted by availability time with changes
before events on ties, and the known changes are carried forward. An entity is cut into
blocks of places, so that no block is larger than the data of ``width`` places. An event
is first tried in the block of its own bound, where almost all find their change. The
others look up the last earlier block that knew anything by then: the same operator over
one row per block, which again is cut into blocks of blocks. Nothing is dropped at any
level, and no task sees a whole entity.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, table, tidy

FANOUT = 256
LEVELS = 3
HOT_EVENTS = 50_000
_FOUND = "rid string, entity string, block long, bound double, at double, change_id long"


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here, places, latest = None, [], {}
    for batch in batches:
        hits = []
        for entity, block, salt, at, is_event, place, cid in zip(
            batch["entity"].to_numpy(), batch["block"].to_numpy(), batch["salt"].to_numpy(), batch["at"].to_numpy(),
            batch["is_event"].to_numpy(), batch["place"].to_numpy(), batch["change_id"].to_numpy(), strict=True,
        ):
            if here != (entity, block, salt):
                here, places, latest = (entity, block, salt), [], {}
            if is_event:
                k = bisect_right(places, place)
                hits.append(latest[places[k - 1]] if k else None)
            else:
                if place not in latest:
                    insort(places, place)
                latest[place] = int(cid)
        events = batch[batch["is_event"] == 1]
        yield pd.DataFrame(
            {"rid": events["rid"], "entity": events["entity"], "block": events["block"], "bound": events["place"], "at": events["at"], "change_id": pd.array(hits, dtype="Int64")}
        )


def _in_block(changes: DataFrame, events: DataFrame) -> DataFrame:
    """One pass over blocks; both inputs carry ``entity, block``."""
    crowd = events.groupBy("entity", "block").count().filter(F.col("count") > HOT_EVENTS)
    crowd = cut(crowd.select("entity", "block", F.ceil(F.col("count") / HOT_EVENTS).alias("n")))
    if crowd.isEmpty():
        changes, events = changes.withColumn("salt", F.lit(0).cast("long")), events.withColumn("salt", F.lit(0).cast("long"))
    else:  # copies of a block's changes are bounded by its places, those of events are none
        n = F.coalesce("n", F.lit(1))
        changes = changes.join(crowd, ["entity", "block"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("n")
        events = events.join(crowd, ["entity", "block"], "left").withColumn("salt", F.pmod(F.xxhash64("rid"), n)).drop("n")
    both = changes.select(
        "entity", "block", "salt", F.col("known").alias("at"), F.lit(0).alias("is_event"), "place", "change_id", F.lit(None).cast("string").alias("rid")
    ).unionByName(events.select("entity", "block", "salt", "at", F.lit(1).alias("is_event"), F.col("bound").alias("place"), F.lit(None).cast("long").alias("change_id"), "rid"))
    return (
        both.withColumns({"change_id": F.coalesce("change_id", F.lit(-1)), "cell": F.xxhash64("entity", "block", "salt")})
        .repartition("cell")  # a key made after the union: its sides may be laid out by the same columns, but coalesced differently
        .sortWithinPartitions("entity", "block", "salt", "at", "is_event", "change_id")
        .drop("cell")
        .mapInPandas(_carry, _FOUND)
    )


def known_at(changes: DataFrame, events: DataFrame, width: float, levels: int = LEVELS) -> DataFrame:
    """Give every event its change: ``rid, change_id`` for events that have one.

    ``changes``: ``entity string, place double, known double, change_id long``;
    ``events``: ``rid string, entity string, bound double, at double``. Rows with a null or
    non-finite clock or a null entity match nothing. Equal changes collapse; of changes
    with the same place and time the greatest id is known. ``width`` is the span of
    places in a block.
    """
    usable = lambda df, *cols: df.dropna(subset=["entity", *cols]).filter(" and ".join(f"not isnan({c}) and abs({c}) < 1.7e308" for c in cols))
    changes = usable(changes, "place", "known").groupBy("entity", "place", "known").agg(F.max("change_id").alias("change_id"))
    events = usable(events, "bound", "at").select("rid", "entity", "bound", "at")
    return _known_at(changes, events, width, levels).select("rid", "change_id")


def _known_at(changes: DataFrame, events: DataFrame, width: float, levels: int) -> DataFrame:
    block = lambda c: (F.floor(F.col(c) / width) if levels > 1 else F.lit(0)).cast("long")
    changes = changes.withColumn("block", block("place"))
    tried = cut(_in_block(changes, events.withColumn("block", block("bound"))))
    hit, miss = tried.filter("change_id is not null"), tried.filter("change_id is null")
    if levels == 1 or miss.isEmpty():
        return hit
    blocks = cut(changes.groupBy("entity", F.col("block").cast("double").alias("place")).agg(F.min("known").alias("known"), F.max("block").alias("change_id")))
    outer = miss.select("rid", "entity", F.col("block").cast("double").alias("bound") - 1, "at", F.col("bound").alias("_bound"))
    outer = outer.toDF("rid", "entity", "bound", "at", "_bound")
    place = _known_at(blocks, outer.drop("_bound"), FANOUT, levels - 1).select("rid", "entity", "at", F.col("change_id").alias("block"))
    late = _in_block(changes, cut(place.withColumn("bound", F.lit(1e308))))
    return hit.unionByName(late.filter("change_id is not null"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    hidden = table(spark, sf_dir, "hidden_events").select(
        "event_id", tidy("dataset_unit_key").alias("entity"), F.col("event_index").cast("double").alias("event_index"), "observed_at", "available_at"
    )
    attrs = table(spark, sf_dir, "unit_attributes").select(
        tidy("dataset_unit_key").alias("entity"), F.col("valid_from_h").alias("place"), F.col("known_at_h").alias("known"), F.col("attr_id").alias("change_id")
    )
    of_events = known_at(
        attrs, hidden.select(F.col("event_id").cast("string").alias("rid"), "entity", F.col("observed_at").alias("bound"), F.col("available_at").alias("at")).distinct(), width=2048.0
    )
    seen = hidden.select("entity", F.col("event_index").alias("place"), F.col("available_at").alias("known"), F.col("event_id").alias("change_id"))
    preds = table(spark, sf_dir, "prediction_ledger").select(
        tidy("prediction_id").alias("rid"), tidy("outer_test_unit").alias("entity"),
        F.col("causal_cutoff_event_index_0based").cast("double").alias("bound"), F.col("origin_time_h").alias("at"),
    ).filter("rid is not null").distinct()
    of_preds = known_at(seen, preds, width=1024.0)
    out = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("rid").alias("record_key"), F.col("change_id").alias("known_id"))
    return out(of_events, "hidden_events").unionByName(out(of_preds, "prediction_ledger"))
