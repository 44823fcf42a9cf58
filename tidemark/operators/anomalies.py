"""Implausible readings, flagged by a hidden Markov model with counted durations.

Each series (unit and measure) is read in order of event index. The states are normal,
the j-th of n spike readings (n up to ``SPIKE_RUN``), and the k-th reading of a stuck run
(the last one, ``STUCK_RUN``, repeats itself). Their emissions:

* normal: any reading; one that exactly equals its predecessor is rare;
* stuck: the first reading differs from its predecessor, each further one equals it, and
  a run can be left only once it has its least length;
* spike: the segment is set against the sound readings before and after it. Its log odds
  grow by ``STEEP`` with every scatter by which it stands off, to one side, beyond
  ``SPIKE_SCATTERS``, as long as those two readings agree within ``AGREE_SCATTERS``;
  entering is priced so that the odds are even at exactly that distance;
* out of range: values that are not finite or outside the measure's hard bounds say
  nothing about the state, which passes them by; the bounds alone flag them.

Forward-backward probabilities assign the flags: a reading is faulty where normal has less
than half of the probability, and of the kind that has most of it.

The sound neighbours of a spike are the next readings that are neither out of range nor in
a run of STUCK_RUN equal ones; where further spikes stand there, the next ones that lie
within ``STRONG`` deviations of the local median.

Series of more than ``BLOCK`` readings are cut into blocks of BLOCK readings by rank, with
margins of ``MARGIN`` readings; their scatter is that of the whole series, from merged counts
of its blocks. Series of fewer than three readings have no scatter and hence no spikes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.readings import MEASURES, TABLES, in_blocks, readings
from tidemark.runtime import cut, whole_groups

#: Physical bounds of each measure.
BOUNDS = {
    "capacity_loss_pct": (-20.0, 100.0),
    "esr_increase_pct": (-60.0, 1000.0),
    "capacity_ratio": (0.0, 1.2),
    "esr_ratio": (0.4, 11.0),
    "case_temp_c": (-40.0, 150.0),
}
BLOCK, MARGIN = 4096, 256
CELLS = 250_000  # readings whose probabilities are held at once
STUCK_RUN, SPIKE_RUN, SPIKE_SCATTERS, AGREE_SCATTERS = 8, 3, 10.0, 7.5
STEEP, MOST = 40.0, 30.0  # log odds for each scatter beyond the limit, and from where on they grow slowly
DEVIATION = 1.4826  # standard deviations of normal differences in one median absolute difference
STRONG = 4.0  # deviations from the local median from which a reading is no neighbour to measure by
MEDIAN_OF = 11
EQUAL = 0.05  # how likely a normal reading equals its predecessor
ENTER_SPIKE, ENTER_STUCK, STAY_STUCK = 0.004, 0.008, 0.97
KINDS = np.array(["normal", "spike", "stuck", "out_of_range"])
NORMAL, SPIKE, STUCK, OUT = range(4)
#: States: 0 normal; then (n, j) of the spikes; then the counted stuck readings.
SEGMENT = [(n, j) for n in range(1, SPIKE_RUN + 1) for j in range(1, n + 1)]
FIRST_STUCK = 1 + len(SEGMENT)
STATES = FIRST_STUCK + STUCK_RUN
_SCHEMA = "tab int, row_key long, measure int, kind string, p_fault double"
_STEPS = "tab int, unit string, measure int, block long, d double, n long, first double, last double"
_NUMBERED = "tab int, unit string, measure int, row_key long, v double, pid int, place long"
_SERIES = ["tab", "unit", "measure"]


def _moves() -> np.ndarray:
    m = np.zeros((STATES, STATES))
    fresh = np.zeros(STATES)
    for k, (_, j) in enumerate(SEGMENT, 1):
        if j == 1:
            fresh[k] = ENTER_SPIKE
    fresh[FIRST_STUCK] = ENTER_STUCK
    fresh[0] = 1 - fresh.sum()
    m[0] = fresh
    for k, (n, j) in enumerate(SEGMENT, 1):
        if j < n:
            m[k, k + 1] = 1
        else:
            m[k] = fresh
    for k in range(FIRST_STUCK, STATES - 1):
        m[k, k + 1] = 1
    m[-1] = (1 - STAY_STUCK) * fresh
    m[-1, -1] += STAY_STUCK
    return m


MOVES = _moves()
#: A series may end in a normal reading, a whole spike or a whole stuck run.
ENDS = np.array([1.0] + [float(j == n) for n, j in SEGMENT] + [0.0] * (STUCK_RUN - 1) + [1.0])


def equal_runs(v: np.ndarray) -> np.ndarray:
    """For every reading the length of the run of exactly equal readings around it."""
    if not len(v):
        return np.zeros(0, int)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return np.repeat(np.diff(np.r_[starts, len(v)]), np.diff(np.r_[starts, len(v)]))


def scatter(v: np.ndarray) -> float:
    """Usual reading-to-reading scatter: the median absolute first difference."""
    d = np.abs(np.diff(v))
    if not len(d):
        return np.nan
    s = np.median(d)
    if s > 0:
        return float(s)
    rest = d[d > 0]
    return float(np.median(rest) * min(1.0, 2 * len(rest) / len(d))) if len(rest) else np.nan


def calm_readings(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """Whether each reading is within bounds and not stuck."""
    return np.isfinite(v) & (v >= low) & (v <= high) & (equal_runs(v) < STUCK_RUN)


def local_median(w: np.ndarray) -> np.ndarray:
    """Median of up to MEDIAN_OF readings around each one, fewer at the ends."""
    n, half = len(w), MEDIAN_OF // 2
    out = np.empty(n)
    edge = np.r_[np.arange(min(half, n)), np.arange(max(half, n - half), n)]
    for k in edge:
        out[k] = np.median(w[max(0, k - half) : k + half + 1])
    if n > 2 * half:
        out[half : n - half] = np.median(np.lib.stride_tricks.sliding_window_view(w, MEDIAN_OF), axis=1)
    return out


def spike_odds(w: np.ndarray, s: float) -> np.ndarray:
    """(readings, SPIKE_RUN) log odds that a spike of n readings begins at each of the sound-looking readings ``w``."""
    size = len(w)
    out = np.full((size, SPIKE_RUN), -MOST)
    x = (w - local_median(w)) / (DEVIATION * s)
    side = np.where(np.abs(x) > STRONG, np.sign(x), 0).astype(int)
    calm = np.flatnonzero(side == 0)
    at = np.arange(size)
    before, after = np.searchsorted(calm, at, "left") - 1, np.searchsorted(calm, at, "right")
    for n in range(1, SPIKE_RUN + 1):
        if size < n + 2:
            break
        first = at[1 : size - n]
        inner = np.lib.stride_tricks.sliding_window_view(w, n)[1:-1]
        low, high = inner.min(axis=1), inner.max(axis=1)

        def odds(b, a, low=low, high=high):
            off = STEEP * (np.maximum(low - np.maximum(a, b), np.minimum(a, b) - high) / s - SPIKE_SCATTERS)
            agree = STEEP * (AGREE_SCATTERS - np.abs(a - b) / s)
            return np.where(agree > MOST, off, np.minimum(off, agree))

        found = odds(w[first - 1], w[first + n])
        if len(calm):
            sides = np.lib.stride_tricks.sliding_window_view(side, n)[1:-1]
            whole = (sides[:, 0] != 0) & (sides == sides[:, :1]).all(axis=1) & (side[first - 1] != sides[:, 0]) & (side[first + n] != sides[:, 0])
            b, a = before[first], after[first + n - 1]
            whole &= (b >= 0) & (a < len(calm))
            found = np.where(whole, np.maximum(found, odds(w[calm[np.maximum(b, 0)]], w[calm[np.minimum(a, len(calm) - 1)]])), found)
        far = np.maximum(found, MOST)  # of two sure readings of one stretch the one that stands off further wins
        out[first, n - 1] = np.where(found > MOST, MOST + 5 * np.log(far / MOST), np.maximum(found, -MOST))
    return out


def emissions(v: np.ndarray, low: float, high: float, s: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods (n, STATES) of one series, and which readings the hard bounds rule out.

    ``s`` is the scatter if the readings are only part of the series.
    """
    n = len(v)
    hard = ~(np.isfinite(v) & (v >= low) & (v <= high))
    calm = calm_readings(v, low, high)
    w = v[calm]
    s = scatter(w) if s is None else s
    e = np.zeros((n, STATES))
    equal = np.r_[False, v[1:] == v[:-1]]
    usual = np.where(equal, EQUAL, 1.0)
    e[:, :FIRST_STUCK] = usual[:, None]
    e[:, FIRST_STUCK] = ~equal
    e[:, FIRST_STUCK + 1 :] = equal[:, None]
    odds = np.full((n, SPIKE_RUN), -MOST)
    if s > 0 and len(w) > 2:
        odds[calm] = spike_odds(w, s)
    for k, (m, j) in enumerate(SEGMENT, 1):
        if j == 1:  # the price of entering is given back, so that the odds stand as they are
            e[:, k] *= np.exp(odds[:, m - 1]) * MOVES[0, 0] ** m / ENTER_SPIKE
    e[hard] = 1.0
    return e, hard


def posteriors(series: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Forward-backward probabilities (n, 4) of the kinds for many series; each is ``emissions``.

    Series of like length run side by side, as many at once as CELLS allows.
    """
    order = np.argsort([-len(e) for e, _ in series], kind="stable")
    out: list[np.ndarray] = [np.zeros((0, 4))] * len(series)
    at = 0
    while at < len(order):
        steps = len(series[order[at]][0])
        some = order[at : at + max(1, CELLS // max(1, steps))]
        at += len(some)
        if steps:
            for i, kinds in zip(some, _side_by_side([series[i] for i in some]), strict=True):
                out[i] = kinds
    return out


def _side_by_side(series: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``posteriors`` of series sorted from the longest to the shortest."""
    lengths = np.array([len(e) for e, _ in series])
    steps = int(lengths[0])
    e = np.ones((steps, len(series), STATES))
    passed = np.zeros((steps, len(series)), bool)
    for k, (one, hard) in enumerate(series):
        e[: lengths[k], k], passed[: lengths[k], k] = one, hard
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # series longer than t come first
    stops = passed.any(axis=1)
    fore = np.zeros_like(e)
    p = np.zeros((len(series), STATES))
    p[:, 0] = 1.0  # before its first reading a series is normal
    for t in range(steps):
        k = alive[t]
        q = p[:k] @ MOVES
        q *= e[t, :k]
        q /= q.sum(axis=1, keepdims=True)
        p = np.where(passed[t, :k, None], p[:k], q) if stops[t] else q
        fore[t, :k] = p
    back = np.tile(ENDS, (len(series), 1))
    turned = np.ascontiguousarray(MOVES.T)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        fore[t, :k] *= back[:k]
        b = (e[t, :k] * back[:k]) @ turned
        b /= b.sum(axis=1, keepdims=True)
        back[:k] = np.where(passed[t, :k, None], back[:k], b) if stops[t] else b
    kinds = np.stack([fore[..., 0], fore[..., 1:FIRST_STUCK].sum(axis=2), fore[..., FIRST_STUCK:].sum(axis=2), np.zeros(fore.shape[:2])], axis=2)
    kinds /= np.maximum(kinds.sum(axis=2, keepdims=True), 1e-300)
    kinds[passed] = [0.0, 0.0, 0.0, 1.0]
    return [kinds[: lengths[k], k] for k in range(len(series))]


def _unit_series(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """``tab, unit, block, measure, row keys, readings, core, scatter`` of every series of whole units."""
    for frame in whole_groups(batches, ["tab", "unit"], 60_000):
        frame = frame[~frame.duplicated(["tab", "unit", "ev", "row_key"])]
        group = frame.groupby(["tab", "unit"], sort=False).ngroup().to_numpy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        tab, unit, key = (frame[c].to_numpy() for c in ("tab", "unit", "row_key"))
        values = [frame[f"m{i}"].to_numpy() for i in range(3)]
        jobs = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            for i in range(len(MEASURES[TABLES[tab[a]]])):
                rows = a + np.flatnonzero(~np.isnan(values[i][a:z]))
                if len(rows):
                    jobs.append((tab[a], unit[a], 0, i, key[rows], values[i][rows], np.ones(len(rows), bool), None))
        yield jobs


def _block_series(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """As ``_unit_series``, of the blocks of long series."""
    for frame in whole_groups(batches, [*_SERIES, "block"], 60_000):
        group = frame.groupby([*_SERIES, "block"], sort=False).ngroup().to_numpy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        tab, unit, block, measure, key, v, core, s = (frame[c].to_numpy() for c in ("tab", "unit", "block", "measure", "row_key", "v", "core", "s"))
        yield [(tab[a], unit[a], block[a], measure[a], key[a:z], v[a:z], core[a:z] == 1, float(s[a])) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each absolute difference of successive calm readings occurs in a block, and its first and last one."""
    for jobs in _block_series(batches):
        parts = []
        for tab, unit, block, i, _, v, core, _ in jobs:
            w = v[calm_readings(v, *BOUNDS[MEASURES[TABLES[tab]][i]]) & core]
            if len(w):
                d, n = np.unique(np.abs(np.diff(w)), return_counts=True)
                parts.append(pd.DataFrame({"tab": tab, "unit": unit, "measure": i, "block": block, "d": np.r_[d, np.nan], "n": np.r_[n, 0], "first": w[0], "last": w[-1]}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def scatters(steps: DataFrame) -> DataFrame:
    """``tab, unit, measure, s``: ``scatter`` of whole series from the ``_steps`` of their blocks.

    The middle differences are looked up in logarithmic bins first and then in the one or
    two bins that hold them, so no series is sorted by one task.
    """
    follow = Window.partitionBy(*_SERIES).orderBy("block")
    ends = steps.filter("n = 0").withColumn("d", F.abs(F.col("first") - F.lag("last").over(follow))).withColumn("n", F.lit(1).cast("long"))
    d = steps.filter("n > 0").unionByName(ends.filter("d is not null")).groupBy(*_SERIES, "d").agg(F.sum("n").alias("n"))
    d = cut(d.withColumn("bin", F.when(F.col("d") > 0, F.floor(F.ln("d") * 100)).otherwise(F.lit(-(1 << 40)))))
    upto = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*_SERIES)
    bins = d.groupBy(*_SERIES, "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("zero"))
    bins = bins.withColumns({"total": F.sum("n").over(whole), "zeros": F.sum("zero").over(whole), "before": upto(whole.orderBy("bin")) - F.col("n")})
    rest, flat = F.col("total") - F.col("zeros"), F.floor(F.col("total") / 2) < F.col("zeros")
    bins = bins.withColumns(
        {
            "lo": F.when(flat, F.col("zeros") + F.floor((rest - 1) / 2)).otherwise(F.floor((F.col("total") - 1) / 2)), "hi": F.when(flat, F.col("zeros") + F.floor(rest / 2)).otherwise(F.floor(F.col("total") / 2)),
            "part": F.when(flat, F.least(F.lit(1.0), 2 * rest / F.col("total"))).otherwise(1.0),
        }
    ).filter(rest > 0)
    within = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("n"))
    near = d.join(bins.filter(within("lo") | within("hi")).select(*_SERIES, "bin", "lo", "hi", "part", F.col("before").alias("base")), [*_SERIES, "bin"])
    near = near.withColumn("before", F.col("base") + upto(Window.partitionBy(*_SERIES, "bin").orderBy("d")) - F.col("n"))
    return near.groupBy(*_SERIES).agg(((F.max(F.when(within("lo"), F.col("d"))) + F.max(F.when(within("hi"), F.col("d")))) / 2 * F.max("part")).alias("s"))


def _flag(jobs_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in jobs_of(batches):
            told = [emissions(v, *BOUNDS[MEASURES[TABLES[tab]][i]], s) for tab, _, _, i, _, v, _, s in jobs]
            parts = []
            for post, (tab, _, _, i, key, _, core, _) in zip(posteriors(told), jobs, strict=True):
                hit = np.flatnonzero((post[:, NORMAL] < 0.5) & core)
                if len(hit):
                    parts.append(pd.DataFrame({"tab": tab, "row_key": key[hit], "measure": i, "kind": KINDS[1 + post[hit, 1:].argmax(axis=1)], "p_fault": 1 - post[hit, NORMAL]}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the readings of each series within the task; rows come sorted, repeated ones count once."""
    pid = TaskContext.get().partitionId()
    last, seen = None, 0
    for b in batches:
        if not len(b):
            continue
        row = [*_SERIES, "ev", "row_key"]
        fresh = ~b.duplicated(row).to_numpy()
        if last is not None:
            fresh &= ~(b[row] == list(last)).all(axis=1).to_numpy()
        b = b[fresh]
        if not len(b):
            continue
        group = b.groupby(_SERIES, sort=False)
        place = group.cumcount().to_numpy()
        if last is not None:
            same = (b[_SERIES] == list(last[:3])).all(axis=1).to_numpy()
            place[same] += seen
        last, seen = tuple(b[row].iloc[-1]), int(place[-1]) + 1
        yield b.assign(pid=pid, place=place)[["tab", "unit", "measure", "row_key", "v", "pid", "place"]]


def ranked(rows: DataFrame) -> DataFrame:
    """``tab, unit, measure, row_key, v, rank`` of every reading: its place in its series.

    Readings are laid out in ranges of series, event index and row key, so no task gets a
    series whole; a range's numbers are shifted by the counts of those before it.
    """
    each = F.posexplode(F.array(*[f"m{i}" for i in range(3)])).alias("measure", "v")
    order = [*_SERIES, "ev", "row_key"]
    long = rows.select("tab", "unit", "row_key", "ev", each).filter("v is not null and not isnan(v)")
    numbered = cut(long.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_number, _NUMBERED))
    upto = Window.partitionBy(*_SERIES).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = numbered.groupBy(*_SERIES, "pid").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    return numbered.join(shifts, [*_SERIES, "pid"]).withColumn("rank", F.col("place") + F.col("shift")).drop("pid", "place", "shift")


def faulty_readings(rows: DataFrame) -> DataFrame:
    """``tab, row_key, measure, kind, p_fault`` of every faulty reading of ``readings()``.

    Null and flagged values are no readings. Repeated rows count once; readings with equal
    event index follow each other by row key. Rows without an event index have no place in
    their series and are left out. An empty input gives an empty result.
    """
    placed = rows.filter("ev is not null").select("tab", "unit", "row_key", "ev", "m0", "m1", "m2")
    sizes = placed.groupBy("tab", "unit").agg(F.count("*").alias("n"))
    long = cut(sizes.filter(F.col("n") > BLOCK).select("tab", "unit"))
    key = ["tab", "unit"]
    whole = lambda df: df.repartition(*key).sortWithinPartitions(*key, "ev", "row_key").mapInPandas(_flag(_unit_series), _SCHEMA)
    if long.isEmpty():
        return whole(placed)
    blocks = cut(in_blocks(ranked(placed.join(long, key, "left_semi")), "rank", BLOCK, MARGIN))
    laid = lambda df: df.repartition(*_SERIES, "block").sortWithinPartitions(*_SERIES, "block", "rank")
    s = scatters(cut(laid(blocks.withColumn("s", F.lit(0.0))).mapInPandas(_steps, _STEPS)))
    told = laid(blocks.join(s, _SERIES, "left").withColumn("s", F.coalesce("s", F.lit(0.0))))
    return whole(placed.join(long, key, "left_anti")).unionByName(told.mapInPandas(_flag(_block_series), _SCHEMA))


def named(df: DataFrame) -> DataFrame:
    """Codes of table and measure replaced by their names."""
    names = F.create_map(*[F.lit(x) for i, t in enumerate(TABLES) for j, m in enumerate(MEASURES[t]) for x in (10 * i + j, m)])
    tables = F.array(*map(F.lit, TABLES))
    return df.withColumn("measure_name", names[F.col("tab") * 10 + F.col("measure")]).withColumn("table_name", tables[F.col("tab")]).drop("tab", "measure")


def p3_flags(spark, sf_dir: str) -> DataFrame:
    return named(faulty_readings(readings(spark, sf_dir)))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return p3_flags(spark, sf_dir).select("table_name", "row_key", "measure_name")
