"""Texts into containers of fixed capacity: bounded-space online best fit.

Texts are sized in tokens of a public tokenizer. Each partition packs its items as they
come into at most ``OPEN_BINS`` open containers. A bitset keyed by free space, bit f for
"some open container has f tokens left", gives the tightest fit as the lowest bit at or
above the item's size; when no container fits and all are open, the fullest closes.
The containers still open at a partition's end are packed once more as whole items, so the
space lost does not grow with the number of partitions. Only sizes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, table

CAPACITY = 2048
OPEN_BINS = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROWS_PER_PARTITION = 250_000
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Tokenizer of a rank file, once per worker."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, text_key, n_tokens``: null and empty texts have 0 tokens; repeated rows collapse."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "n_tokens": np.array(n, np.int64)})

    sized = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "text")
    return sized.mapInPandas(count, "doc_id long, text_key long, n_tokens long").dropDuplicates(["doc_id", "text_key", "n_tokens"])


class BestFit:
    """Open containers under their free space; ``put`` returns the number of an item's container."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.n_open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        free -= size
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.n_open += 1
        return number

    def still_open(self) -> set[int]:
        return {n for held in self.by_free.values() for n in held}


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        fit = BestFit(capacity, open_bins)
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "part": part, "bin": [fit.put(int(n)) for n in b["size"]], "open": -1})
        for n in fit.still_open():
            yield pd.DataFrame({"item": [None], "part": [part], "bin": [n], "open": [1]})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``item, container_id`` for items ``item string (unique), size long`` with 0 < size <= capacity.

    Placement depends on the items alone: partitions are hashes of the item and each is
    read in a fixed order, so a task that runs again makes the same containers.
    """
    n_parts = max(1, -(-items.count() // ROWS_PER_PARTITION))
    laid = items.select("item", "size").repartition(n_parts, "item").sortWithinPartitions(F.xxhash64("item"), "item")
    schema = "item string, part int, bin long, open int"
    first = cut(laid.mapInPandas(_pack(capacity, open_bins), schema))
    left = first.filter("open = 1").select("part", "bin")
    filled = first.filter("open = -1").join(left, ["part", "bin"], "left_semi").join(items, "item").groupBy("part", "bin").agg(F.sum("size").alias("size"))
    again = filled.select(F.concat_ws("/", "part", "bin").alias("item"), "size").repartition(max(1, -(-n_parts * open_bins // ROWS_PER_PARTITION)), "item").sortWithinPartitions(F.desc("size"), "item")
    second = again.mapInPandas(_pack(capacity, 4 * open_bins), schema).filter("open = -1").select(F.col("item").alias("_bin"), F.col("part").alias("part2"), F.col("bin").alias("bin2"))
    placed = first.filter("open = -1").withColumn("_bin", F.concat_ws("/", "part", "bin")).join(second, "_bin", "left")
    number = lambda p, b, base: (F.lit(base) + F.col(p)).cast("long") * (1 << 24) + F.col(b)
    return placed.select("item", F.when(F.col("part2").isNull(), number("part", "bin", 0)).otherwise(number("part2", "bin2", n_parts)).alias("container_id"))


def containers(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, text_key, piece, token_start, n_tokens, container_id``.

    A text longer than the capacity is cut into pieces of exactly the capacity and a rest;
    every other text is one piece. Texts without tokens (null or empty) take no space: one
    row with 0 tokens and a null container. Rows repeated as they are count once.
    """
    sized = cut(token_counts(docs, path))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1).cast("long"))
    cutup = sized.select("doc_id", "text_key", "n_tokens", F.explode(pieces).alias("piece"))
    cutup = cutup.withColumn("token_start", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity), F.col("n_tokens") - F.col("token_start")).cast("long"))
    cutup = cutup.withColumn("item", F.concat_ws(":", F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_key", "piece"))
    placed = pack(cutup.filter("size > 0").select("item", "size"), capacity, open_bins)
    return cutup.join(placed, "item", "left").select("doc_id", "text_key", "piece", "token_start", F.col("size").alias("n_tokens"), "container_id")


def p7_containers(spark, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """How many containers there are, what they hold and how much of them is unused."""
    got = containers(table(spark, sf_dir, "documents")).filter("container_id is not null")
    return got.agg(
        F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
        F.round(1 - F.sum("n_tokens") / (F.count_distinct("container_id") * CAPACITY), 6).alias("unused_share"),
    )
