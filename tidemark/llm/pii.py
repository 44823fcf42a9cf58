"""Personal information in free text, found by a trained tagger.

The tagger of ``pii_model`` reads every text whole, in overlapping windows. Each character
takes its scores from the window in whose middle it lies, and one CRF decoding over the
joined scores of the text settles all windows together. The decoded spans are the answer;
only their ends may move, by at most EDGE characters, to the end of a word, a bracket or
an initial's full stop. No list, label or pattern decides what is personal.

Soft hyphens and zero-width spaces are skipped and full-width signs read as plain ones,
but every span is reported and replaced as it stands in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pii_model import FRAME, TAGS, allowed, emissions, encode, load, one_core
from tidemark.llm.pii_text import TYPES
from tidemark.runtime import table

WINDOW, MARGIN, BATCH = 512, 32, 256
EDGE = 4  # characters by which an end of a span may move
CHUNK = 1_000_000  # characters scored at once
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

_RARE_SPACE = re.compile(r"[^\S \n]")


def plain(text: str) -> tuple[str, np.ndarray | None]:
    """The text as the tagger and the forms read it, and each sign's place in the original (None: the same)."""
    if text.isascii():
        return text, None
    spaced = text.replace("\u00a0", " ")
    if "\u200b" not in spaced and "\u00ad" not in spaced and unicodedata.is_normalized("NFKC", spaced) and not _RARE_SPACE.search(spaced):
        return spaced, None  # sign by sign the same
    out, at = [], []
    for k, ch in enumerate(text):
        if ch in "\u200b\u00ad":
            continue
        c = ch if ch < "\x80" else unicodedata.normalize("NFKC", ch)
        if len(c) != 1:
            c = ch
        if c != "\n" and c.isspace():
            c = " "
        out.append(c)
        at.append(k)
    at.append(len(text))
    return "".join(out), np.array(at)


def scores(texts: list[str], w: dict) -> list[np.ndarray]:
    """(length, tags) scores of each text from windows that overlap by twice MARGIN."""
    step = WINDOW - 2 * MARGIN
    pad = encode("\n")[0]
    wins, where = [], []
    frame = len(FRAME)
    coded = [encode(FRAME + t + FRAME) for t in texts]
    for k, s in enumerate(coded):
        for a in range(0, max(1, len(s) - 2 * MARGIN), step):
            piece = s[a : a + WINDOW]
            wins.append(piece)
            where.append((k, a))
    order = sorted(range(len(wins)), key=lambda i: -len(wins[i]))
    out = [np.empty((len(s), len(TAGS)), np.float32) for s in coded]
    for b in range(0, len(order), BATCH):
        some = order[b : b + BATCH]
        longest = len(wins[some[0]])
        block = np.full((longest, len(some)), pad, np.int16)
        for j, i in enumerate(some):
            block[: len(wins[i]), j] = wins[i]
        e = emissions(w, block, np.array([len(wins[i]) for i in some]))
        for j, i in enumerate(some):
            k, a = where[i]
            n = len(wins[i])
            lo = 0 if a == 0 else MARGIN
            hi = n if a + n >= len(coded[k]) else n - MARGIN
            out[k][a + lo : a + hi] = e[lo:hi, j]
    return [x[frame:-frame] for x in out]


def decode(es: list[np.ndarray], trans: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Spans of the best tag sequence of each text; all texts are decoded side by side, longest first."""
    order = sorted(range(len(es)), key=lambda i: -len(es[i]))
    lengths = np.array([len(es[i]) for i in order])
    out: list[list[tuple[int, int, str]]] = [[] for _ in es]
    if not len(order) or not lengths[0]:
        return out
    # Tags lie first so that texts are contiguous: "outside" and beginnings, which any tag may
    # precede, then continuations, which only their type's two tags may. The way back is
    # found from the kept scores, one tag a text, instead of from pointers for all tags.
    turn = np.r_[0, 1 : len(TAGS) : 2, 2 : len(TAGS) : 2]
    n_open = 1 + len(TYPES)
    trans = trans[np.ix_(turn, turn)]
    flat = np.ascontiguousarray(np.concatenate([es[i] for i in order]).T[turn])
    at = np.r_[0, np.cumsum(lengths)[:-1]]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    into = np.ascontiguousarray(trans[:, :n_open, None])
    begun = trans[np.arange(1, n_open), np.arange(n_open, len(TAGS))][:, None]
    inside = trans[np.arange(n_open, len(TAGS)), np.arange(n_open, len(TAGS))][:, None]
    best = flat[:, at[: alive[0]]] + trans[0][:, None]
    kept = [best]
    for t in range(1, int(lengths[0])):
        k = alive[t]
        was = best[:, :k]
        best = flat[:, at[:k] + t]
        best[:n_open] += (was[:, None, :] + into).max(axis=0)
        best[n_open:] += np.maximum(was[1:n_open] + begun, was[n_open:] + inside)
        kept.append(best)
    path = np.zeros(flat.shape[1], np.uint8)
    now = np.zeros(len(order), np.int64)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k, ends = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
        if ends < k:  # texts whose last sign this is
            now[ends:k] = (kept[t][:, ends:k] + trans[:, :1]).argmax(axis=0)
        path[at[:k] + t] = turn[now[:k]]
        if t:
            now[:k] = (kept[t - 1][:, :k] + trans[:, now[:k]]).argmax(axis=0)
    begins = np.flatnonzero(path & 1)  # odd tags begin a span, even ones continue it
    text_of = np.searchsorted(at, begins, side="right") - 1
    for start, j in zip(begins.tolist(), text_of.tolist(), strict=True):
        kind, stop, limit = path[start], start + 1, int(at[j] + lengths[j])
        while stop < limit and path[stop] == kind + 1:
            stop += 1
        out[order[j]].append((start - int(at[j]), stop - int(at[j]), TYPES[kind >> 1]))
    return out


_LOOSE = " \n\t,;:|/<>\"„“”«»="


def edges(text: str, a: int, z: int, kind: str) -> tuple[int, int]:
    """The span with its ends moved by at most EDGE characters: whole words, no loose signs, brackets in pairs."""
    low, high = max(0, a - EDGE), min(len(text), z + EDGE)
    word = lambda k: text[k].isalnum()
    k = a
    while k > low and word(k) and word(k - 1):
        k -= 1
    if k == 0 or not (word(k) and word(k - 1)):
        a = k
    k = z
    while k < high and word(k - 1) and word(k):
        k += 1
    if k == len(text) or not (word(k - 1) and word(k)):
        z = k
    stop = a + EDGE
    while a < min(z, stop) and text[a] in _LOOSE:
        a += 1
    stop = z - EDGE
    while z > max(a, stop) and text[z - 1] in _LOOSE:
        z -= 1
    inner = text[a:z]
    extra = inner.count(")") - inner.count("(")
    if extra > 0 and inner[-1] == ")":
        z -= 1
    elif extra > 0 and a and text[a - 1] == "(":
        a -= 1
    elif extra < 0 and inner[0] == "(":
        a += 1
    elif extra < 0 and z < len(text) and text[z] == ")":
        z += 1
    elif inner[:1] == "(" and inner.find(")") == len(inner) - 1:
        a, z = a + 1, z - 1
    if kind == "phone" and a and text[a - 1] == "+":
        a -= 1
    if kind == "name":
        lone = lambda k: k > a and text[k - 1].isupper() and (k - 1 == a or not word(k - 2))
        if z < len(text) and text[z] == "." and lone(z):
            z += 1
        elif text[z - 1 : z] == "." and not lone(z - 1):
            z -= 1
    elif text[z - 1 : z] in (".", "?", "!"):
        z -= 1
    return a, z


def settle(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of one type that touch are one; then the ends are moved. What keeps fewer than three letters or digits is none."""
    joined: list[tuple[int, int, str]] = []
    for a, z, kind in spans:
        if joined and joined[-1][1] == a and joined[-1][2] == kind:
            joined[-1] = joined[-1][0], z, kind
        else:
            joined.append((a, z, kind))
    out: list[tuple[int, int, str]] = []
    for a, z, kind in joined:
        a, z = edges(text, a, z, kind)
        a = max(a, out[-1][1]) if out else a
        if sum(c.isalnum() for c in text[a:z]) >= 3:
            out.append((a, z, kind))
    return out


def find(texts: list[str], w: dict) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text in its own characters."""
    trans = w["t"] + allowed()
    results: list[list[tuple[int, int, str]]] = []
    k = 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k]) <= CHUNK):
            some.append(plain(texts[k]))
            size += len(texts[k])
            k += 1
        for (text, at), spans in zip(some, decode(scores([t for t, _ in some], w), trans), strict=True):
            spans = settle(text, spans)
            results.append(spans if at is None else [(int(at[a]), int(at[z - 1]) + 1, t) for a, z, t in spans])
    return results


def _spans(w: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_core()
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            out = [(doc, kind, text[a:z]) for doc, text, spans in zip(b["doc_id"], texts, find(texts, w), strict=True) for a, z, kind in spans]
            yield pd.DataFrame(out, columns=["doc_id", "pii_type", "pii_text"])

    return run


def _redact(w: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_core()
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            clean, counts = [], []
            for text, raw, spans in zip(texts, b["text"], find(texts, w), strict=True):
                parts, last = [], 0
                for a, z, kind in spans:
                    parts += [text[last:a], PLACEHOLDER[kind]]
                    last = z
                clean.append("".join([*parts, text[last:]]) if isinstance(raw, str) else None)
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": clean, "n_replaced": counts})

    return run


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, pii_type, pii_text``: once per document and text. Null and empty texts have none.

    The one shuffle of the texts drops repeated rows and spreads the tagging over all
    cores, which takes a hundred times as long as moving them.
    """
    return docs.select("doc_id", "text").filter("text is not null").distinct().mapInPandas(_spans(load()), "doc_id long, pii_type string, pii_text string").distinct()


def redacted(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_replaced``: each text with typed placeholders for what is personal, all else unchanged; null stays null."""
    return docs.select("doc_id", "text").repartition(F.xxhash64("doc_id", "text")).mapInPandas(_redact(load()), "doc_id long, text string, n_replaced int")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents"))


def p9_redacted(spark, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"))
