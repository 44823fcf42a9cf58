"""Connected components by parallel hooking and shortcutting, and splits that respect them."""

from __future__ import annotations

from math import gcd, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut, table, tidy

#: Spellings that name nothing.
PLACEHOLDERS = ["", "-", "n/a", "unknown"]
SALTS = 16
MAX_ROUNDS = 200
SPLITS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
POOL_BITS = 1 << 22
MOST_BITS = 1 << 30  # bits of the largest bitset times the number of sizes in it


def links(marks: DataFrame) -> DataFrame:
    """Edges ``u, v`` that join all units with the same mark, as stars.

    ``marks`` has ``unit, mark``. A mark's units are spread over SALTS stars whose centres
    hang on the smallest, so a mark shared by a third of all rows is no single group.
    Units and marks that are null link nothing.
    """
    marks = marks.select("unit", "mark").dropna().distinct().withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(SALTS)))
    stars = marks.groupBy("mark", "salt").agg(F.min("unit").alias("centre"))
    hubs = stars.groupBy("mark").agg(F.min("centre").alias("hub"))
    inner = marks.join(stars, ["mark", "salt"]).select(F.col("unit").alias("u"), F.col("centre").alias("v"))
    outer = stars.join(hubs, "mark").select(F.col("centre").alias("u"), F.col("hub").alias("v"))
    return inner.unionByName(outer).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``unit, group_key``: every unit of any edge with the smallest unit of its component.

    The parent array is a table ``unit, parent``. A round looks up grandparents, hooks
    each unit and its parent onto the smallest grandparent among its neighbours, and
    shortcuts units to their grandparents; components halve, so rounds grow with the
    logarithm of the size. Each round is cut into the shared folder. An empty edge table
    gives an empty result; loops and repeated edges change nothing.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = cut(both)
    state = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("f")))
    for _ in range(MAX_ROUNDS):
        up = state.select(F.col("u").alias("f"), F.col("f").alias("gf"))
        known = state.join(up, "f").select("u", "f", "gf")
        near = both.join(known.select(F.col("u").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("gf"))
        hooks = known.drop("gf").join(near, "u")
        moves = known.select("u", F.col("gf").alias("to")).unionByName(hooks.select("u", F.col("gf").alias("to"))).unionByName(hooks.select(F.col("f").alias("u"), F.col("gf").alias("to")))
        best = moves.groupBy("u").agg(F.min("to").alias("to"))
        after = cut(state.join(best, "u").select("u", F.least("f", "to").alias("f"), (F.col("to") < F.col("f")).alias("moved")))
        state = after.select("u", "f")
        if after.filter("moved").isEmpty():
            return state.select(F.col("u").alias("unit"), F.col("f").alias("group_key"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def unit_marks(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stress2_events").select(tidy("dataset_unit_key").alias("unit"), tidy("physical_unit_id").alias("p"), tidy("possible_duplicate_group").alias("g")).distinct()
    real = lambda c: F.when(~F.col(c).isin(PLACEHOLDERS), F.concat(F.lit(f"{c}:"), F.col(c)))
    return rows.select("unit", F.explode(F.array(real("p"), real("g"))).alias("mark")).filter("mark is not null")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Units that share a split with another one; linked units always have a neighbour, so none is alone."""
    return components(links(unit_marks(spark, sf_dir))).select(F.col("unit").alias("dataset_unit_key"), "group_key")


def subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many items of each size add up as closely as possible to ``target`` (below it on ties).

    Bit k of the running bitset says that total k can be reached; multiplicities enter in
    powers of two, so a size with n items costs log n shifts. For the way back only every
    so-manieth bitset is kept and those between are built again, so that memory grows with
    the root of their number.
    """
    layers: list[tuple[int, int]] = []
    for size in sorted(sizes, reverse=True):
        left, step = sizes[size], 1
        while left > 0:
            n = min(step, left)
            layers.append((size, n))
            left -= n
            step *= 2
    stride = max(1, isqrt(len(layers)))
    kept, reach = [], 1
    for k, (size, n) in enumerate(layers):
        if k % stride == 0:
            kept.append(reach)
        reach |= reach << (size * n)
    below = reach & ((1 << (target + 1)) - 1)
    above = reach >> (target + 1)
    total = below.bit_length() - 1
    if above:
        up = target + (above & -above).bit_length()
        if up - target < target - total:
            total = up
    took = dict.fromkeys(sizes, 0)
    for c in range(len(kept) - 1, -1, -1):
        some = layers[c * stride : (c + 1) * stride]
        before = [kept[c]]
        for size, n in some[:-1]:
            before.append(before[-1] | before[-1] << (size * n))
        for (size, n), reach in zip(reversed(some), reversed(before), strict=True):
            if not reach >> total & 1:
                took[size] += n
                total -= size * n
    return took


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """As ``subset``, with bitsets over a pool where all sizes together exceed POOL_BITS.

    A greedy choice in proportion comes within the largest size u of the target. Some
    closest choice differs from it by at most 4u/g + 4 items, g being the common divisor of
    the sizes: in a longer list of changes, put in an order that keeps partial sums near
    zero, two partial sums are equal and the changes between them can be left out. Pools
    around the greedy choice therefore grow until they hold that many items of each size,
    until the total is as near as any multiple of g can be, or until their bitsets reach
    MOST_BITS; then the total is at least as near as the greedy one, within u.
    """
    if sum(s * n for s, n in sizes.items()) <= POOL_BITS:
        return subset(sizes, target)
    fits = {s: n for s, n in sizes.items() if s <= target}
    total = sum(s * n for s, n in fits.items())
    took = dict.fromkeys(sizes, 0)
    if total <= target:
        took |= fits
    else:
        start = {s: n * target // total for s, n in fits.items()}
        missing = target - sum(s * n for s, n in start.items())
        for s in sorted(fits, reverse=True):
            more = min(fits[s] - start[s], missing // s)
            start[s] += more
            missing -= s * more
        g = gcd(*fits)
        least, enough = min(target % g, -target % g), 4 * max(fits) // g + 4
        bits, classes = max(1, POOL_BITS // 64), 64
        while True:
            near = sorted(fits)[:classes]
            reach = {s: min(enough, bits // (2 * s * len(near))) for s in near}
            low = {s: max(0, n - reach.get(s, 0)) for s, n in start.items()}
            pool = {s: min(n, start[s] + reach.get(s, 0)) - low[s] for s, n in fits.items()}
            chosen = subset({s: n for s, n in pool.items() if n}, target - sum(s * n for s, n in low.items()))
            took |= {s: n + chosen.get(s, 0) for s, n in low.items()}
            off = abs(sum(s * n for s, n in took.items()) - target)
            if off == least or all(pool[s] == n or reach.get(s, 0) == enough for s, n in fits.items()) or bits * min(classes, len(fits)) * 16 > MOST_BITS:
                break
            bits, classes = bits * 4, classes * 4
    # a component above the target is closest alone or not at all
    above = min((s for s, n in sizes.items() if s > target and n), default=None)
    if above is not None and above - target < abs(sum(s * n for s, n in took.items()) - target):
        took = dict.fromkeys(sizes, 0) | {above: 1}
    return took


def quotas(sizes: dict[int, int], shares: tuple[tuple[str, float], ...] = SPLITS) -> dict[str, dict[int, int]]:
    """For each split but the first, how many components of each size it gets.

    Each split in turn comes as close to its share of all rows as what is left allows,
    whatever the sizes; components too large for a split stay out of its proportions.
    """
    total = sum(s * n for s, n in sizes.items())
    left = {s: n for s, n in sizes.items() if s > 0}
    given = {}
    for name, share in shares[1:]:
        given[name] = closest(left, round(share * total))
        for s, n in given[name].items():
            left[s] -= n
    return given


def split_units(weights: DataFrame, groups: DataFrame, shares: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """``unit, group_key, split``: units of one group share a split, split totals are in turn closest to ``shares``.

    ``weights`` has ``unit, n`` (rows that count towards the shares, null as 0), ``groups``
    is a result of ``components``; a unit without a group is its own. Only the number of
    groups of each size goes to the driver. Which groups of a size go where follows a hash
    of the group key; ranks come from counts of hash buckets, so no size is one task.
    """
    units = weights.groupBy("unit").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    units = cut(units.filter("unit is not null").join(groups.select("unit", "group_key"), "unit", "left").withColumn("group_key", F.coalesce("group_key", "unit")))
    totals = units.groupBy("group_key").agg(F.sum("n").alias("size")).withColumn("h", F.xxhash64("group_key")).withColumn("bucket", F.pmod("h", F.lit(256)))
    totals = cut(totals)
    counts = totals.groupBy("size", "bucket").count()
    sizes = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # distinct sizes: at most the root of twice the rows
    before = F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "group_key"))
    ranked = totals.withColumn("rn", rank).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("rn") + F.col("before"))
    bounds, upto = [], dict.fromkeys(sizes, 0)
    for name, took in quotas(sizes, shares).items():
        for s, n in took.items():
            if n:
                bounds.append((s, upto[s], upto[s] + n, name))
                upto[s] += n
    spark = weights.sparkSession
    bounds_df = spark.createDataFrame(bounds or [(-1, 0, 0, "")], "size long, lo long, hi long, split string")
    mine = ranked.alias("r").join(bounds_df.alias("b"), (F.col("r.size") == F.col("b.size")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")), "left")
    named = mine.select("group_key", F.coalesce("split", F.lit(shares[0][0])).alias("split"))
    return units.join(named, "group_key").select("unit", "group_key", "split", "n")


def p6_splits(spark, sf_dir: str) -> DataFrame:
    """Every unit of endpoint_labels and prediction_ledger with its split and its rows in both."""
    labels = table(spark, sf_dir, "endpoint_labels")
    labels = labels.withColumn("dataset_unit_key", tidy("dataset_unit_key")).distinct().groupBy(F.col("dataset_unit_key").alias("unit")).agg(F.count("*").alias("n"))
    preds = table(spark, sf_dir, "prediction_ledger").select(tidy("prediction_id").alias("id"), tidy("outer_test_unit").alias("unit")).distinct().groupBy("unit").agg(F.count("*").alias("n_predictions"))
    weights = labels.unionByName(preds.select("unit", F.lit(0).cast("long").alias("n")))
    out = split_units(weights, components(links(unit_marks(spark, sf_dir))))
    return out.join(preds, "unit", "left").select(
        F.col("unit").alias("dataset_unit_key"), "group_key", "split", F.col("n").alias("n_labels"), F.coalesce("n_predictions", F.lit(0)).alias("n_predictions")
    )


def p6_group_splits(spark, sf_dir: str) -> DataFrame:
    """Of every group of linked units among those that are split: its units and the number of splits they lie in, which must be one."""
    groups = p6_splits(spark, sf_dir).groupBy("group_key").agg(F.count("*").alias("n_units"), F.countDistinct("split").alias("n_splits"))
    return groups.filter("n_units > 1")
