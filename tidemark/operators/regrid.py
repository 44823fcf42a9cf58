"""Irregular readings onto a regular grid by a Kalman smoother.

Per unit and measure the level follows a continuous-time local linear trend. Readings at
their own times and the slots of the unit's acquisition plan form one time line; the
filter runs forward over it and the Rauch-Tung-Striebel smoother back, so every slot gets
a level with its standard deviation, and a flag if no usable reading fell into it.

The grid of a unit and table runs from its first to its last slot with any timed row.
Noise and trend scale are those of the whole series: the median absolute first difference
to within a hundredth, read off a histogram that can be merged. A reading far from the
median of the eleven around it counts with a larger noise.

Grids of more than ``BLOCK`` slots are cut into blocks, and still smoothed as a whole:

1. each block states its histograms and its first and last readings;
2. a source's few statements are merged into its noise and each block's neighbours;
3. each block states what it does to any state that enters it and what its readings say
   about that state: one element of the associative scan of the linear filter;
4. the elements of a source are combined from both sides, which gives the filtered state at
   the entry of each block and the information from behind its exit;
5. each block is filtered from that entry and smoothed from that exit.

So what comes out does not depend on the blocks. Slots are laid out inside the tasks and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.anomalies import local_median, named
from tidemark.operators.readings import MEASURES, TABLES, readings
from tidemark.runtime import cut, table, tidy, whole_groups

BLOCK = 2048
TREND = 2e-3  # variance that the trend gains over one cadence, in units of the noise variance
OUTLYING = 9.0  # squared standardised distance from the local median beyond which a reading's noise is inflated
BROADCAST_ROWS = 100_000  # long sources whose keys may travel with the tasks; more are joined by shuffle
BINS = 100  # histogram bins for each factor of e
BESIDE = 5  # readings of other blocks that the local median may ask for
_SCHEMA = "tab int, unit string, measure int, slot long, value double, sd double, n_readings int"
_STATED = "tab int, unit string, block long, measure int, bins array<int>, counts array<long>, heads array<double>, tails array<double>"
_MERGED = "tab int, unit string, block long, measure int, noise double, start double, before array<double>, after array<double>"
_ELEMENT = "tab int, unit string, block long, measure int, element array<double>, noise double, start double, cadence double"
_STATE = "tab int, unit string, block long, measure int, entry array<double>, behind array<double>"


def transition(dt, r, q):
    """Covariance that the state gains over ``dt``."""
    return q * dt**3 / 3 + 1e-6 * r * dt, q * dt * dt / 2, q * dt


def smooth(t, y, rk, r, q, entry, behind):
    """Smoothed level and variance of many series: ``t, y, rk`` are (steps, series), NaN in ``y`` is no reading.

    ``rk`` is each reading's noise variance, ``r`` the series' one, ``q`` the spectral
    density of its slope. ``entry`` (5, series) is the state at the first time: level,
    slope and covariance; ``behind`` (5, series) is the information about the last state
    from readings after it: vector and matrix, zero if there are none.
    """
    steps, n = t.shape
    m0, m1, p00, p01, p11 = entry
    keep = np.empty((10, steps, n))
    for k in range(steps):
        if k:
            dt = t[k] - t[k - 1]
            a, b, c = transition(dt, r, q)
            m0 = m0 + dt * m1
            p00, p01, p11 = p00 + 2 * dt * p01 + dt * dt * p11 + a, p01 + dt * p11 + b, p11 + c
        keep[:5, k] = m0, m1, p00, p01, p11
        seen = ~np.isnan(y[k])
        gap = np.where(seen, y[k] - m0, 0.0)
        s = p00 + rk[k]
        g0, g1 = np.where(seen, p00 / s, 0.0), np.where(seen, p01 / s, 0.0)
        m0, m1 = m0 + g0 * gap, m1 + g1 * gap
        p00, p01, p11 = p00 * (1 - g0), p01 * (1 - g0), p11 - g1 * p01
        keep[5:, k] = m0, m1, p00, p01, p11
    # The last filtered state joined with what is known from behind: (I + P J)^-1 (m + P h), (I + P J)^-1 P.
    a0, a1, b00, b01, b11 = told(*keep[5:, -1], *behind)
    out, var = np.empty((steps, n)), np.empty((steps, n))
    out[-1], var[-1] = a0, np.maximum(b00, 0)
    for k in range(steps - 2, -1, -1):
        dt = t[k + 1] - t[k]
        m0, m1, c00, c01, c11 = keep[5:, k]
        w0, w1, d00, d01, d11 = keep[:5, k + 1]
        f00, f01, f10, f11 = c00 + dt * c01, c01, c01 + dt * c11, c11  # filtered covariance times transition, transposed
        det = np.maximum(d00 * d11 - d01 * d01, 1e-300)
        j00, j01 = (f00 * d11 - f01 * d01) / det, (f01 * d00 - f00 * d01) / det
        j10, j11 = (f10 * d11 - f11 * d01) / det, (f11 * d00 - f10 * d01) / det
        e0, e1 = a0 - w0, a1 - w1
        a0, a1 = m0 + j00 * e0 + j01 * e1, m1 + j10 * e0 + j11 * e1
        x00, x01, x11 = b00 - d00, b01 - d01, b11 - d11
        y00, y01, y10, y11 = j00 * x00 + j01 * x01, j00 * x01 + j01 * x11, j10 * x00 + j11 * x01, j10 * x01 + j11 * x11
        b00, b01, b11 = c00 + y00 * j00 + y01 * j01, c01 + y00 * j10 + y01 * j11, c11 + y10 * j10 + y11 * j11
        out[k], var[k] = a0, np.maximum(b00, 0)
    return out, var


def _root(m: np.ndarray) -> np.ndarray:
    """A matrix L with L L' = m, for symmetric matrices that may be singular."""
    values, vectors = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return vectors * np.sqrt(np.maximum(values, 0))[..., None, :]


def _within(m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(m^-1 + j)^-1 for a covariance that may be singular, without taking its inverse."""
    root = _root(m)
    turned = np.swapaxes(root, -1, -2)
    return root @ np.linalg.inv(np.eye(2) + turned @ j @ root) @ turned


def _of(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _square(x00, x01, x11) -> np.ndarray:
    return np.stack([np.stack([x00, x01], -1), np.stack([x01, x11], -1)], -2)


def told(m0, m1, p00, p01, p11, h0, h1, j00, j01, j11):
    """State joined with information about it: mean and covariance."""
    m, j = np.stack([m0, m1], -1), _square(j00, j01, j11)
    p = _within(_square(p00, p01, p11), j)
    m = m + _of(p, np.stack([h0, h1], -1) - _of(j, m))
    return m[..., 0], m[..., 1], p[..., 0, 0], p[..., 0, 1], p[..., 1, 1]


def element(t, y, rk, r, q) -> tuple:
    """What a stretch of steps does to a state x at its first time, as an element (A, b, C, h, J) of the scan.

    Given x the last state is normal about A x + b with covariance C, and the readings say
    h - J x about x. A filter that starts at x itself, without doubt, gives all of these.
    Arguments as in ``smooth``.
    """
    steps, n = t.shape
    zero, one = np.zeros(n), np.ones(n)
    a00, a01, a10, a11 = one, zero, zero, one
    b0 = b1 = c00 = c01 = c11 = h0 = h1 = j00 = j01 = j11 = zero
    for k in range(steps):
        if k:
            dt = t[k] - t[k - 1]
            q00, q01, q11 = transition(dt, r, q)
            a00, a01, b0 = a00 + dt * a10, a01 + dt * a11, b0 + dt * b1
            c00, c01, c11 = c00 + 2 * dt * c01 + dt * dt * c11 + q00, c01 + dt * c11 + q01, c11 + q11
        seen = ~np.isnan(y[k])
        s = c00 + rk[k]
        w = np.where(seen, 1 / s, 0.0)
        gap = np.where(seen, y[k] - b0, 0.0)
        h0, h1 = h0 + a00 * gap * w, h1 + a01 * gap * w
        j00, j01, j11 = j00 + a00 * a00 * w, j01 + a00 * a01 * w, j11 + a01 * a01 * w
        g0, g1 = c00 * w, c01 * w
        b0, b1 = b0 + g0 * gap, b1 + g1 * gap
        a00, a01, a10, a11 = a00 - g0 * a00, a01 - g0 * a01, a10 - g1 * a00, a11 - g1 * a01
        c00, c01, c11 = c00 * (1 - g0), c01 * (1 - g0), c11 - g1 * c01
    return np.stack([a00, a01, a10, a11], -1).reshape(n, 2, 2), np.stack([b0, b1], -1), _square(c00, c01, c11), np.stack([h0, h1], -1), _square(j00, j01, j11)


def onward(state: tuple, e: tuple) -> tuple:
    """The state (mean, covariance) behind a stretch, from the one before it."""
    (m, p), (a, b, c, h, j) = state, e
    p = _within(p, j)
    m = m + _of(p, h - _of(j, m))
    return _of(a, m) + b, a @ p @ np.swapaxes(a, -1, -2) + c


def backward(known: tuple, e: tuple) -> tuple:
    """What a stretch and all behind it say about the state before it, from what is known behind it."""
    (h, j), (a, b, c, he, je) = known, e
    turned = np.swapaxes(a, -1, -2)
    part = _within(j, c)  # (j^-1 + c)^-1
    x = h - _of(j, b)
    return _of(turned, x - _of(part, _of(c, x))) + he, turned @ part @ a + je


def histogram(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the first differences that are not zero, by size, and how many lie in each."""
    d = np.abs(np.diff(v))
    d = d[(d > 0) & np.isfinite(d)]
    return np.unique(np.floor(np.log(d) * BINS).astype(np.int64), return_counts=True)


def noise_variance(bins: np.ndarray, counts: np.ndarray) -> float:
    """Of the median difference; differences are of two readings, hence the half."""
    if not len(bins):
        return 1e-12
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(counts[order])
    middle = bins[order][np.searchsorted(upto, (upto[-1] + 1) // 2)]
    return max((1.4826 * np.exp((middle + 0.5) / BINS)) ** 2 / 2, 1e-12)


def reading_noise(v: np.ndarray, before, after, r: float) -> np.ndarray:
    """Noise variance of each reading; ``before`` and ``after`` are the readings beside them."""
    w = np.r_[np.asarray(before, float), v, np.asarray(after, float)]
    off = (w - local_median(w))[len(before) : len(before) + len(v)]
    return np.maximum(r, off * off / OUTLYING)


class Stretch:
    """A block's part of one series: its time line from edge to edge, and where its slots lie in it."""

    def __init__(self, first: int, last: int, cadence: float, t, v, noise) -> None:
        slots = np.arange(first, last + 1)
        times = np.r_[(first - 0.5) * cadence, t, slots * cadence, (last + 0.5) * cadence]
        by = np.argsort(times, kind="stable")
        none = np.full(len(slots) + 1, np.nan)
        self.t, self.y = times[by], np.r_[np.nan, v, none][by]
        self.noise = np.r_[1.0, noise, np.ones(len(slots) + 1)][by]
        self.slots, self.at = slots, np.flatnonzero((by > len(t)) & (by <= len(t) + len(slots)))


def prior(start: float, r: float, cadence: float) -> list[float]:
    """Before anything is read: the first reading's level, and any slope that steps could show."""
    return [start, 0.0, 100 * r + 1e-12, 0.0, 100 * r / cadence**2]


def _stacked(stretches: list[Stretch]) -> Iterator[tuple[np.ndarray, tuple]]:
    """Like-sized stretches side by side: their numbers and (steps, series) arrays; the last step repeats to fill up."""
    order = np.argsort([len(s.t) for s in stretches], kind="stable")
    for at in range(0, len(order), 128):
        some = order[at : at + 128]
        steps = max(len(stretches[i].t) for i in some)
        t, y, rk = np.empty((steps, len(some))), np.full((steps, len(some)), np.nan), np.ones((steps, len(some)))
        for k, i in enumerate(some):
            s, n = stretches[i], len(stretches[i].t)
            t[:n, k], t[n:, k], y[:n, k], rk[:n, k] = s.t, s.t[-1], s.y, s.noise
        yield some, (t, y, rk)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Of every block on a grid: table, unit, block, first and last slot, cadence, and times, slots and readings of each measure."""
    for frame in whole_groups(batches, ["tab", "unit", "block"], 60_000):
        frame = frame[~frame.duplicated(["tab", "unit", "block", "head", "row_key"])]
        group = frame.groupby(["tab", "unit", "block"], sort=False).ngroup().to_numpy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        tab, unit, block, head, slot, t, low, cadence = (frame[c].to_numpy() for c in ("tab", "unit", "block", "head", "slot", "t", "low", "cadence"))
        values = [frame[f"m{i}"].to_numpy() for i in range(3)]
        out = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if head[a]:
                series = []
                for i in range(len(MEASURES[TABLES[tab[a]]])):
                    rows = a + 1 + np.flatnonzero(np.isfinite(values[i][a + 1 : z]))
                    series.append((t[rows], slot[rows].astype(np.int64), values[i][rows]))
                out.append((tab[a], unit[a], int(block[a]), int(low[a]), int(slot[a]), float(cadence[a]), series, a))
        yield frame, out


def _frame(done: list[tuple]) -> pd.DataFrame:
    """done: table, unit, measure, stretch, slots of its readings, level and variance at its slots."""
    sizes = [len(d[3].slots) for d in done]
    each = lambda k: np.repeat(np.array([d[k] for d in done], dtype=object if k == 1 else np.int64), sizes)
    n = [np.bincount(d[4] - d[3].slots[0], minlength=len(d[3].slots)) for d in done]
    return pd.DataFrame({
        "tab": each(0), "unit": each(1), "measure": each(2), "slot": np.concatenate([d[3].slots for d in done]), "value": np.concatenate([d[5] for d in done]),
        "sd": np.sqrt(np.concatenate([d[6] for d in done])), "n_readings": np.concatenate(n),
    })


def _smoothed(jobs: list[tuple]) -> Iterator[pd.DataFrame]:
    """jobs: table, unit, measure, stretch, slots of its readings, noise, cadence, entry, behind (entry None: no reading anywhere)."""
    live = [k for k, j in enumerate(jobs) if j[7] is not None]
    empty = [j for j in jobs if j[7] is None]
    if empty:
        yield _frame([(*j[:5], *(np.full(len(j[3].slots), np.nan),) * 2) for j in empty])
    for some, (t, y, rk) in _stacked([jobs[k][3] for k in live]):
        mine = [jobs[live[k]] for k in some]
        r, cadence = np.array([j[5] for j in mine]), np.array([j[6] for j in mine])
        level, var = smooth(t, y, rk, r, TREND * r / cadence**3, np.array([j[7] for j in mine]).T, np.array([j[8] for j in mine]).T)
        yield _frame([(*j[:5], level[j[3].at, k], var[j[3].at, k]) for k, j in enumerate(mine)])


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units that are one block."""
    for _, parts in _parts(batches):
        jobs = []
        for tab, unit, _, first, last, cadence, series, _ in parts:
            for i, (t, slot, v) in enumerate(series):
                r = noise_variance(*histogram(v))
                stretch = Stretch(first, last, cadence, t, v, reading_noise(v, [], [], r))
                jobs.append((tab, unit, i, stretch, slot, r, cadence, prior(v[0], r, cadence) if len(v) else None, [0.0] * 5))
        for frame in _smoothed(jobs):
            yield frame


def _state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 1: histograms, first and last readings of every block."""
    for _, parts in _parts(batches):
        out = []
        for tab, unit, block, _, _, _, series, _ in parts:
            for i, (_, _, v) in enumerate(series):
                bins, counts = histogram(v)
                out.append((tab, unit, block, i, bins.tolist(), counts.tolist(), v[:BESIDE].tolist(), v[-BESIDE:].tolist()))
        yield pd.DataFrame(out, columns=["tab", "unit", "block", "measure", "bins", "counts", "heads", "tails"])


def _merge(stated: pd.DataFrame) -> pd.DataFrame:
    """Step 2, of one series: its noise, its first reading and what stands beside each block."""
    stated = stated.sort_values("block")
    heads, tails = ([np.asarray(x, float) for x in stated[c]] for c in ("heads", "tails"))
    bins, counts = (np.concatenate([np.asarray(x, np.int64) for x in stated[c]]) for c in ("bins", "counts"))
    before, after, last = [], [None] * len(heads), np.zeros(0)
    for h, w in zip(heads, tails, strict=True):
        before.append(last)
        if len(h) and len(last):
            b, c = histogram(np.r_[last[-1], h[0]])
            bins, counts = np.r_[bins, b], np.r_[counts, c]
        last = np.r_[last, w][-BESIDE:]
    follow = np.zeros(0)
    for k in range(len(heads) - 1, -1, -1):
        after[k] = follow
        follow = np.r_[heads[k], follow][:BESIDE]
    r = noise_variance(bins, counts)
    first = next((h[0] for h in heads if len(h)), np.nan)
    return stated[["tab", "unit", "block", "measure"]].assign(noise=r, start=first, before=[x.tolist() for x in before], after=[x.tolist() for x in after])


def _lists(frame: pd.DataFrame, at: int, i: int, name: str):
    """The cell of measure ``i`` in a column that a block's head row carries for all measures."""
    return frame[name].iloc[at][i]


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3."""
    for frame, parts in _parts(batches):
        keys, stretches, noise, cadences = [], [], [], []
        for tab, unit, block, first, last, cadence, series, a in parts:
            for i, (t, _, v) in enumerate(series):
                r = float(_lists(frame, a, i, "noise"))
                keys.append((tab, unit, block, i, float(_lists(frame, a, i, "start"))))
                stretches.append(Stretch(first, last, cadence, t, v, reading_noise(v, _lists(frame, a, i, "before"), _lists(frame, a, i, "after"), r)))
                noise.append(r)
                cadences.append(cadence)
        for some, (t, y, rk) in _stacked(stretches):
            r, cadence = np.array(noise)[some], np.array(cadences)[some]
            flat = np.concatenate([x.reshape(len(some), -1) for x in element(t, y, rk, r, TREND * r / cadence**3)], axis=1)
            yield pd.DataFrame([(*keys[k][:4], flat[m].tolist(), noise[k], keys[k][4], cadences[k]) for m, k in enumerate(some)], columns=["tab", "unit", "block", "measure", "element", "noise", "start", "cadence"])


def _scan(elements: pd.DataFrame) -> pd.DataFrame:
    """Step 4, of one series: the state at the entry of each block and the information from behind its exit."""
    elements = elements.sort_values("block")
    parts = [(e[:4].reshape(1, 2, 2), e[4:6].reshape(1, 2), e[6:10].reshape(1, 2, 2), e[10:12].reshape(1, 2), e[12:].reshape(1, 2, 2)) for e in (np.asarray(x, float) for x in elements["element"])]
    m0, m1, p00, p01, p11 = (np.array([x]) for x in prior(elements["start"].iloc[0], elements["noise"].iloc[0], elements["cadence"].iloc[0]))
    state, known = (np.stack([m0, m1], -1), _square(p00, p01, p11)), (np.zeros((1, 2)), np.zeros((1, 2, 2)))
    told_as = lambda x, m: [*x[0], m[0, 0, 0], (m[0, 0, 1] + m[0, 1, 0]) / 2, m[0, 1, 1]]
    entries, behind = [], [None] * len(parts)
    for e in parts:
        entries.append(told_as(*state))
        state = onward(state, e)
    for k in range(len(parts) - 1, -1, -1):
        behind[k] = told_as(*known)
        known = backward(known, parts[k])
    return elements[["tab", "unit", "block", "measure"]].assign(entry=entries, behind=behind)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 5."""
    for frame, parts in _parts(batches):
        jobs = []
        for tab, unit, _, first, last, cadence, series, a in parts:
            for i, (t, slot, v) in enumerate(series):
                r, empty = float(_lists(frame, a, i, "noise")), np.isnan(float(_lists(frame, a, i, "start")))
                stretch = Stretch(first, last, cadence, t, v, reading_noise(v, _lists(frame, a, i, "before"), _lists(frame, a, i, "after"), r))
                jobs.append((tab, unit, i, stretch, slot, r, cadence, None if empty else list(_lists(frame, a, i, "entry")), list(_lists(frame, a, i, "behind"))))
        for out in _smoothed(jobs):
            yield out


def onto_grid(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``tab, unit, measure, slot, value, sd, n_readings``: every slot of every unit and measure.

    ``rows`` are ``readings()``, ``plans`` has ``member, cadence``. A slot without a finite,
    unflagged reading has ``n_readings`` 0 and carries the smoothed value. Rows without a
    finite time, or whose slot number is beyond 2**62, count nowhere; units without a plan
    have no grid. A measure without any reading has null values. Repeated rows count once.
    """
    rows = rows.select("tab", "unit", "member", "row_key", "t", "m0", "m1", "m2")
    plans = plans.filter("cadence > 0").groupBy("member").agg(F.max("cadence").alias("cadence"))
    timed = rows.filter("t is not null and not isnan(t)").join(plans, "member")
    timed = timed.filter(F.abs(F.col("t") / F.col("cadence")) < 2.0**62).withColumn("slot", F.floor(F.col("t") / F.col("cadence") + 0.5).cast("long"))
    ends = timed.groupBy("tab", "unit").agg(F.min("slot").alias("_a"), F.max("slot").alias("_z"), F.max("cadence").alias("cadence"))
    at = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    ends = cut(ends.withColumn("one", at("_a") == at("_z")))
    key = ["tab", "unit", "block"]
    long = ends.filter("not one").select("tab", "unit")
    n_long = long.count()
    long = F.broadcast(long) if n_long <= BROADCAST_ROWS else long

    def laid(one: bool, held: DataFrame, more: DataFrame | None = None) -> DataFrame:
        mine = ends.filter(F.col("one") == one).withColumn("block", F.explode(F.sequence(at("_a"), at("_z")))).select(
            *key, F.lit(True).alias("head"), F.least("_z", F.col("block") * BLOCK + BLOCK - 1).alias("slot"), F.greatest("_a", F.col("block") * BLOCK).alias("low"), "cadence",
            F.lit(-1e300).alias("t"), *[F.lit(None).cast("double").alias(f"m{i}") for i in range(3)], F.lit(-1).cast("long").alias("row_key"),
        )
        mine = mine.join(more, key) if more is not None else mine
        body = held.select("tab", "unit", at("slot").alias("block"), F.lit(False).alias("head"), "slot", F.lit(0).cast("long").alias("low"), "cadence", "t", "m0", "m1", "m2", "row_key")
        both = mine.unionByName(body, allowMissingColumns=True).withColumn("cell", F.xxhash64(*key))
        # A key made after the union: partitions of its two sides by the same columns may be coalesced differently.
        return both.repartition("cell").sortWithinPartitions(*key, F.desc("head"), "t", "row_key").drop("cell")

    short = timed.join(long, ["tab", "unit"], "left_anti") if n_long else timed
    whole = laid(True, short).mapInPandas(_whole, _SCHEMA)
    if not n_long:
        return whole
    held = cut(timed.join(long, ["tab", "unit"], "left_semi").select("tab", "unit", "slot", "cadence", "t", "m0", "m1", "m2", "row_key"))
    series = ["tab", "unit", "measure"]
    by_measure = lambda df, *cols: df.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.struct("measure", c)))[c].alias(c) for c in cols])  # noqa: E731  # at most three measures
    merged = cut(laid(False, held).mapInPandas(_state, _STATED).groupBy(*series).applyInPandas(_merge, _MERGED))
    beside = by_measure(merged, "noise", "start", "before", "after")
    states = cut(laid(False, held, beside).mapInPandas(_elements, _ELEMENT).groupBy(*series).applyInPandas(_scan, _STATE))
    known = beside.join(by_measure(states, "entry", "behind"), key)
    return whole.unionByName(laid(False, held, known).mapInPandas(_finish, _SCHEMA))


def p2_grid(spark, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "acquisition_plans").select(tidy("source_member").alias("member"), F.col("cadence_h").alias("cadence"))
    out = named(onto_grid(readings(spark, sf_dir), plans))
    return out.select("table_name", F.col("unit").alias("dataset_unit_key"), "measure_name", "slot", "value", "sd", "n_readings", (F.col("n_readings") == 0).alias("is_missing"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return p2_grid(spark, sf_dir).filter("is_missing").select("table_name", "dataset_unit_key", "measure_name", "slot")
