"""Character-level bidirectional LSTM with a linear-chain CRF, in numpy: training and inference.

A character enters as its base letter and a case bit, so the input table is small and
unseen letters share weights. Each direction has HIDDEN units. Training runs Adam on the
exact CRF likelihood; inference runs many windows of a text side by side.
"""

from __future__ import annotations

import ctypes
import multiprocessing as mp
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

from tidemark.llm.pii_text import TYPES, Writer

ALPHABET = "\n !\"#$%&'()*+,-./09:;<=>?@[]_abcdefghijklmnopqrstuvwxyz{|}°"
OTHER_LETTER, OTHER_SIGN, PAD = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2
VOCAB = len(ALPHABET) + 3
TAGS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
HIDDEN = 64
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@lru_cache(maxsize=1 << 16)
def symbol(ch: str) -> int:
    """Twice the letter's number, plus one for capitals."""
    base = unicodedata.normalize("NFKD", ch)[0] if not ch.isascii() else ch
    if base.isspace():
        return 2 * ALPHABET.index("\n" if base == "\n" else " ")
    if base.isdigit():
        return 2 * ALPHABET.index("0" if base == "0" else "9")
    if ch == "ß":
        base = "s"
    low = base.lower()
    upper = int(base != low)
    k = ALPHABET.find(low) if len(low) == 1 else -1
    if k < 0:
        k = OTHER_LETTER if base.isalpha() else OTHER_SIGN
    return 2 * k + upper


_ASCII = np.array([symbol(chr(i)) for i in range(128)], np.int16)


def encode(text: str) -> np.ndarray:
    if text.isascii():
        return _ASCII[np.frombuffer(text.encode("ascii"), np.uint8)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(codes, 127)]
    wide = np.flatnonzero(codes > 127)
    out[wide] = [symbol(text[k]) for k in wide.tolist()]
    return out


def allowed() -> np.ndarray:
    """0 where tag b may follow tag a, a large negative number where it may not."""
    bad = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for a, x in enumerate(TAGS):
        for b, y in enumerate(TAGS):
            if y[0] == "I" and x[1:] != y[1:]:
                bad[a, b] = -1e4
    return bad


def initial(seed: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"x{d}"] = r.normal(0, 0.25, (VOCAB, 4 * hidden)).astype(np.float32)
        w[f"c{d}"] = r.normal(0, 0.1, (4 * hidden,)).astype(np.float32)
        w[f"u{d}"] = (r.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        b = np.zeros(4 * hidden, np.float32)
        b[hidden : 2 * hidden] = 1.0
        w[f"b{d}"] = b
    w["o"] = r.normal(0, 0.1, (2 * hidden, len(TAGS))).astype(np.float32)
    w["ob"] = np.zeros(len(TAGS), np.float32)
    w["t"] = np.zeros((len(TAGS), len(TAGS)), np.float32)
    return w


def _table(w, d) -> np.ndarray:
    """Input to the gates of every symbol, lower and upper."""
    x = np.repeat(w[f"x{d}"], 2, axis=0) + w[f"b{d}"]
    x[1::2] += w[f"c{d}"]
    return x


def _scan(table, u, symbols, hidden, alive=None):
    """One direction over (steps, batch) symbols. Gate order: input, forget, output, candidate.

    With ``alive`` (rows in use at each step, the first so many) the others stand still at
    zero, so what a text gets does not depend on the padding beside it.
    """
    steps, n = symbols.shape
    alive = np.full(steps, n) if alive is None else alive
    h, c, out = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), np.empty((steps, n, hidden), np.float32)
    return _scan_alive(table, u, symbols, hidden, alive, h, c, out)


def _scan_alive(table, u, symbols, hidden, alive, h, c, out):
    half = np.full(4 * hidden, 0.5, np.float32)
    half[3 * hidden :] = 1.0
    table, u = table * half, u * half
    k3 = 3 * hidden
    for t, k in enumerate(alive):
        z = table[symbols[t, :k]]
        z += h[:k] @ u
        np.tanh(z, out=z)
        gates = z[:, :k3]
        gates *= 0.5
        gates += 0.5
        cell = c[:k]
        cell *= z[:, hidden : 2 * hidden]
        cell += z[:, :hidden] * z[:, k3:]
        np.multiply(z[:, 2 * hidden : k3], np.tanh(cell), out=h[:k])
        out[t, :k] = h[:k]
        out[t, k:] = 0
    return out


def emissions(w: dict[str, np.ndarray], symbols: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """(steps, batch, tags) scores of (steps, batch) symbols; with ``lengths``, falling, of texts of unequal length."""
    hidden = w["uf"].shape[0]
    alive = None if lengths is None else np.searchsorted(-np.asarray(lengths), -np.arange(len(symbols)), side="left")
    f = _scan(_table(w, "f"), w["uf"], symbols, hidden, alive)
    b = _scan(_table(w, "b"), w["ub"], symbols[::-1], hidden, None if alive is None else alive[::-1])
    return f @ w["o"][:hidden] + b[::-1] @ w["o"][hidden:] + w["ob"]


def crf_loss(e: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood per character and its gradients; every step of the windows counts.

    Forward and backward run on scaled probabilities, so each step is a small matrix product.
    """
    steps, n, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x, m = np.exp(e - top) + e.dtype.type(1e-30), np.exp(trans)
    a, b, c = np.empty_like(x), np.ones_like(x), np.empty((steps, n, 1), x.dtype)
    now = x[0]
    for t in range(steps):
        if t:
            now = (now @ m) * x[t]
        c[t] = now.sum(axis=1, keepdims=True)
        now = now / c[t]
        a[t] = now
    mt = m.T.copy()
    for t in range(steps - 2, -1, -1):
        b[t] = ((x[t + 1] * b[t + 1]) @ mt) / c[t + 1]
    z = float(np.log(c.astype(np.float64)).sum() + top.sum(dtype=np.float64))
    gold = np.take_along_axis(e, tags[:, :, None], 2).sum(dtype=np.float64) + trans[tags[:-1], tags[1:]].sum(dtype=np.float64)
    ge = a * b
    np.put_along_axis(ge, tags[:, :, None], np.take_along_axis(ge, tags[:, :, None], 2) - 1, 2)
    gt = m * (a[:-1].reshape(-1, k).T @ (x[1:] * b[1:] / c[1:]).reshape(-1, k))
    np.subtract.at(gt, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    scale = 1.0 / (steps * n)
    return (z - gold) * scale, ge * e.dtype.type(scale), (gt * scale).astype(e.dtype)


def _forward(tables, u, symbols):
    """Both directions side by side over (steps, 2 * batch) rows of ``tables``; keeps what the way back needs."""
    steps, n, hidden = len(symbols), symbols.shape[1] // 2, u.shape[1]
    dtype = tables.dtype
    h, c = np.zeros((2, n, hidden), dtype), np.zeros((2, n, hidden), dtype)
    gates, before, tc = (np.empty((steps, 2, n, k * hidden), dtype) for k in (4, 1, 1))
    half = np.full(4 * hidden, 0.5, dtype)
    half[3 * hidden :] = 1.0
    tables, u = tables * half, u * half  # the sigmoid of x is half the hyperbolic tangent of x / 2, plus a half
    k3 = 3 * hidden
    for t in range(steps):
        z = tables[symbols[t]].reshape(2, n, -1)
        z += h @ u
        z = np.tanh(z, out=gates[t])
        z[..., :k3] *= 0.5
        z[..., :k3] += 0.5
        before[t] = c
        c = z[..., hidden : 2 * hidden] * c
        c += z[..., :hidden] * z[..., k3:]
        h = z[..., 2 * hidden : k3] * np.tanh(c, out=tc[t])
    return gates, before, tc


def _back(tables, u, symbols, memory, gh):
    """Gradients of both directions: of the tables and the recurrent weights."""
    z, before, tc = memory
    steps, _, n, hidden = before.shape
    i, f, o, g = (z[..., k * hidden : (k + 1) * hidden] for k in range(4))
    every = np.empty_like(z)
    # Local slopes of all steps at once; only the sums through time go step by step.
    slope = o * (1 - tc * tc)
    every[..., :hidden], every[..., hidden : 2 * hidden] = g * i * (1 - i), before * f * (1 - f)
    every[..., 2 * hidden : 3 * hidden], every[..., 3 * hidden :] = tc * o * (1 - o), i * (1 - g * g)
    dh, dc = np.zeros((2, n, hidden), z.dtype), np.zeros((2, n, hidden), z.dtype)
    ut = np.ascontiguousarray(u.transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        dh += gh[t]
        dc += dh * slope[t]
        dz = every[t].reshape(2, n, 4, hidden)
        dz[:, :, :2] *= dc[:, :, None]
        dz[:, :, 2] *= dh
        dz[:, :, 3] *= dc
        dh = every[t] @ ut
        dc *= f[t]
    h = o[:-1] * tc[:-1]
    gu = np.stack([h[:, d].reshape(-1, hidden).T @ every[1:, d].reshape(-1, 4 * hidden) for d in (0, 1)])
    gx = np.zeros(tables.shape, z.dtype)
    flat = symbols.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    gx[flat[order[starts]]] = np.add.reduceat(every.reshape(-1, 4 * hidden)[order], starts, axis=0)
    return gx, gu


def gradients(w, symbols, tags):
    hidden = w["uf"].shape[0]
    tables = np.concatenate([_table(w, "f"), _table(w, "b")])
    u = np.stack([w["uf"], w["ub"]])
    both = np.concatenate([symbols, symbols[::-1] + len(tables) // 2], axis=1)
    memory = _forward(tables, u, both)
    h = memory[0][..., 2 * hidden : 3 * hidden] * memory[2]
    f, b = h[:, 0], h[::-1, 1]
    e = f @ w["o"][:hidden] + b @ w["o"][hidden:] + w["ob"]
    loss, ge, gt = crf_loss(e, w["t"] + allowed(), tags)
    g = {"t": gt, "ob": ge.sum(axis=(0, 1))}
    flat = ge.reshape(-1, ge.shape[2])
    g["o"] = np.concatenate([f.reshape(-1, hidden).T @ flat, b.reshape(-1, hidden).T @ flat])
    back = ge @ w["o"].T
    gx, gu = _back(tables, u, both, memory, np.stack([back[..., :hidden], back[::-1, :, hidden:]], axis=1))
    for d, x, v in (("f", gx[: len(gx) // 2], gu[0]), ("b", gx[len(gx) // 2 :], gu[1])):
        g[f"u{d}"] = v
        g[f"x{d}"], g[f"c{d}"], g[f"b{d}"] = x[0::2] + x[1::2], x[1::2].sum(axis=0), x.sum(axis=0)
    return loss, g


#: What every text is put between, in training and in use, so that its ends look alike in both.
FRAME = "\n\n"


def labelled(writer: Writer, batch: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of freshly written texts, one after another: symbols and tags, both (steps, batch)."""
    sy, tg = np.empty((steps, batch), np.int64), np.empty((steps, batch), np.int64)
    symbols, tags = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(batch):
        while len(symbols) < steps:
            text, spans = writer.text(int(20 * 60 ** writer.r.random()))
            text = FRAME + text + FRAME
            more = np.zeros(len(text), np.int64)
            for a, z, kind in spans:
                a, z = a + len(FRAME), z + len(FRAME)
                more[a:z] = 2 + 2 * TYPES.index(kind)
                more[a] -= 1
            symbols, tags = np.r_[symbols, encode(text)], np.r_[tags, more]
        sy[:, k], tg[:, k] = symbols[:steps], tags[:steps]
        symbols, tags = symbols[steps:], tags[steps:]
    return sy, tg


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _worker(pipe, seed: int, like: dict[str, np.ndarray]) -> None:
    writer = Writer(seed)
    while (told := pipe.recv()) is not None:
        flat, batch, steps = told
        loss, g = gradients(_shaped(flat, like), *labelled(writer, batch, steps))
        pipe.send((loss, _flat(g).astype(np.float32)))


def train(n_batches: int, seed: int = 0, batch: int = 14, steps: int = 144, hidden: int = HIDDEN, rate: float = 6e-3, workers: int = 8, start=None, say=None) -> dict[str, np.ndarray]:
    """Fit the tagger to generated text; the bound on training data is n_batches * workers * batch * steps characters.

    Each worker process writes its own text and sends the gradient of its batch; Adam
    takes their mean, so the result depends on the seed and the number of workers only.
    The first two fifths of the steps take windows of half the length. The weights are a
    running mean over the last fifth.
    """
    w = start or initial(seed, hidden)
    like = {k: np.empty_like(v) for k, v in w.items()}
    context = mp.get_context("spawn")
    pipes, processes = [], []
    for k in range(workers):
        mine, theirs = context.Pipe()
        p = context.Process(target=_worker, args=(theirs, seed * 1000 + k, like), daemon=True)
        p.start()
        pipes.append(mine)
        processes.append(p)
    flat = _flat(w)
    m, s, mean = np.zeros_like(flat), np.zeros_like(flat), flat.copy()
    for step in range(1, n_batches + 1):
        for p in pipes:
            p.send((flat, *((2 * batch, steps // 2) if step <= 0.4 * n_batches else (batch, steps))))
        got = [p.recv() for p in pipes]
        x = np.mean([g for _, g in got], axis=0)
        x *= np.float32(min(1.0, 0.5 / (np.sqrt(float((x.astype(np.float64) ** 2).sum())) + 1e-9)))
        lr = rate * min(1.0, step / 50) * (0.5 * (1 + np.cos(np.pi * step / n_batches)) * 0.98 + 0.02)
        m += np.float32(0.1) * (x - m)
        s += np.float32(0.005) * (x * x - s)
        flat = flat - np.float32(lr) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.995**step)) + np.float32(1e-8))
        mean = flat if step < 0.8 * n_batches else mean + (flat - mean) / np.float32(100)
        if say and step % 50 == 0:
            say(f"{step} {np.mean([v for v, _ in got]):.5f}")
    for p, q in zip(pipes, processes, strict=True):
        p.send(None)
        q.join()
    return _shaped(mean, like)


def save(w: dict[str, np.ndarray], path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in w.items()})


@lru_cache(maxsize=1)
def one_core() -> bool:
    """Keep numpy's matrix products of this process on one core; a task has one, and more threads only wait for each other."""
    done = False
    for library in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(str(library)), name)(1)
                done = True
            except (AttributeError, OSError):
                pass
    return done


def load(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


if __name__ == "__main__":
    import sys

    save(train(int(sys.argv[1]) if len(sys.argv) > 1 else 6500, say=lambda x: print(x, flush=True)), Path(sys.argv[2]) if len(sys.argv) > 2 else WEIGHTS)
