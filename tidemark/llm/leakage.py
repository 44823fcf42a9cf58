"""Evaluation texts leaking into a corpus, also with other numbers, names or units.

Texts are read as words; numbers, names and units become typed placeholders. Windows of
twelve placeholder words (shorter items: all their words) are hashed and joined between
items and documents. A placeholder depends on its word alone, so equal words always have
equal templates and no verbatim passage is lost. The slots of a joined window then decide:
equal words are a verbatim leak; words that differ in slots only, with every item value
replaced by one value throughout, are a re-parameterised one. For these, texts are also
read with each decimal as one word, so that 29.7 can stand for 30.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import rolling
from tidemark.operators.scoring import budget
from tidemark.runtime import cut, table

WINDOW = 12
WINDOW_LIMIT = 200_000  # item windows that may travel with the tasks
NAME_LIMIT = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that are units of measurement.
UNITS = [
    "a", "ah", "c", "celsius", "day", "days", "degrees", "f", "farad", "h", "hour", "hours", "hz", "k", "kelvin", "khz", "kohm", "kv", "kw", "m", "ma", "mah", "mf", "mhz", "min", "minute",
    "minutes", "mm", "mohm", "ms", "mv", "mw", "mwh", "nf", "ohm", "ohms", "pct", "percent", "pf", "s", "second", "seconds", "uf", "v", "volt", "volts", "w", "watt", "wh", "µf", "μf",
]
_WORD = re.compile(r"[^\W_]+")
_SLOT = re.compile(r"(?<![^\W_])\d+[.,]\d+(?![^\W_])|[^\W_]+")
_MATCH = "doc_id long, h long, n int, pos int, words array<string>"


def words(text: str, decimals: bool = False) -> list[str]:
    """Maximal runs of letters or digits after NFKC, without U+200B and U+00AD, in lower case.

    With ``decimals``, two numbers with a decimal sign between them are one word.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u00ad", "")
    return (_SLOT if decimals else _WORD).findall(text.lower())


def _number(word: str) -> bool:
    """Digits, or a decimal: words are letters and digits else."""
    return word.isdigit() or not word.isalnum()


class Templates:
    """Word -> hash of its template word; 0 for words that no item has, if the items' words are given."""

    def __init__(self, names: list[str], vocabulary: list[str] | None = None) -> None:
        known = {n: self._hash("<name>") for n in names} | {u: self._hash("<unit>") for u in UNITS}
        self.number = self._hash("<number>")
        self.closed = vocabulary is not None
        self.table = {w: known.get(w) or (self.number if _number(w) else self._hash(w)) for w in vocabulary or []} | known

    @staticmethod
    def _hash(word: str) -> int:
        return xxhash.xxh64_intdigest(word) or 1

    def of(self, ws: list[str]) -> np.ndarray:
        get, number = self.table.get, self.number
        if self.closed:
            return np.array([get(w) or (number if _number(w) else 0) for w in ws], np.uint64)
        return np.array([get(w) or (number if _number(w) else self._hash(w)) for w in ws], np.uint64)


def item_windows(items: DataFrame, names: list[str], decimals: bool = False) -> DataFrame:
    """``item_id, h, n, words``: every window of every item; items without words have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(names)
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["item_text"], strict=True):
                ws = words(text, decimals) if isinstance(text, str) else []
                if ws and item == item:
                    n = min(WINDOW, len(ws))
                    h = rolling(templates.of(ws), n, BASE).view(np.int64)
                    out += [(item, int(h[i]), n, ws[i : i + n]) for i in range(len(ws) - n + 1)]
            yield pd.DataFrame(out, columns=["item_id", "h", "n", "words"])

    return items.select("item_id", "item_text").mapInPandas(run, "item_id long, h long, n int, words array<string>").distinct()


def document_windows(docs: DataFrame, names: list[str], sizes: list[int], vocabulary: list[str] | None, wanted: dict[int, np.ndarray] | None, decimals: bool = False) -> DataFrame:
    """``doc_id, h, n, pos, words`` of document windows; only ``wanted`` hashes per size, if given. ``pos`` counts a decimal as two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(names, vocabulary)
        for b in batches:
            ids, lists = [], []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                if isinstance(text, str):
                    ws = words(text, decimals)
                    if ws:
                        ids.append(doc)
                        lists.append(ws)
            if not ids:
                continue
            gap = np.zeros(WINDOW, np.uint64)
            parts, starts, at = [], [], 0
            for ws in lists:
                starts.append(at)
                parts += [templates.of(ws), gap]
                at += len(ws) + WINDOW
            tok, starts = np.concatenate(parts), np.array(starts)
            zeros = np.r_[0, np.cumsum(tok == 0)]
            out = []
            for n in sizes:
                full = zeros[n:] == zeros[: len(zeros) - n]
                at = np.flatnonzero(full)
                h = rolling(tok, n, BASE).view(np.int64)[at]
                if wanted is not None:
                    k = np.minimum(np.searchsorted(wanted[n], h), len(wanted[n]) - 1)
                    hit = wanted[n][k] == h
                    at, h = at[hit], h[hit]
                d = np.searchsorted(starts, at, side="right") - 1
                places = {i: [0, *accumulate(1 + (not w.isalnum()) for w in lists[i])] for i in set(d.tolist())} if decimals else None
                for i, p, x in zip(d.tolist(), (at - starts[d]).tolist(), h.tolist(), strict=True):
                    out.append((ids[i], x, n, places[i][p] if places else p, lists[i][p : p + n]))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "h", "n", "pos", "words"])

    return docs.select("doc_id", "text").mapInPandas(run, _MATCH)


def document_hashes(docs: DataFrame, names: list[str], sizes: list[int], decimals: bool = False) -> DataFrame:
    """``doc_id, h, n, at`` of all document windows, without their words; ``at`` counts words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(names)
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                tok = templates.of(words(text, decimals)) if isinstance(text, str) else np.zeros(0, np.uint64)
                for n in sizes:
                    if len(tok) >= n:
                        h = rolling(tok, n, BASE).view(np.int64)[: len(tok) - n + 1]
                        yield pd.DataFrame({"doc_id": doc, "h": h, "n": n, "at": np.arange(len(h))})

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, h long, n int, at long")


def fetched_windows(docs: DataFrame, hits: DataFrame, names: list[str], decimals: bool = False) -> DataFrame:
    """``doc_id, h, n, pos, words`` of the windows named in ``hits`` (``doc_id, h, n, at``), read again from their texts."""
    wanted = hits.groupBy("doc_id").agg(F.collect_list(F.struct("h", "n", "at")).alias("hits"))  # of one document, no more than its windows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(names)
        for b in batches:
            out = []
            for doc, text, hits in zip(b["doc_id"], b["text"], b["hits"], strict=True):
                ws = words(text, decimals)
                place = [0, *accumulate(1 + (not w.isalnum()) for w in ws)]
                tok = templates.of(ws)
                done = {n: rolling(tok, n, BASE).view(np.int64) for n in {x["n"] for x in hits}}
                out += [(doc, x["h"], x["n"], place[x["at"]], ws[x["at"] : x["at"] + x["n"]]) for x in hits if x["at"] + x["n"] <= len(ws) and done[x["n"]][x["at"]] == x["h"]]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "h", "n", "pos", "words"])

    return docs.select("doc_id", "text").filter("text is not null").join(wanted, "doc_id").mapInPandas(run, _MATCH)


def leaks(docs: DataFrame, items: DataFrame, roster: DataFrame, decimals: bool = False) -> DataFrame:
    """``doc_id, item_id, pos, n, verbatim, consistent``: every joined window with its slot check.

    Null and blank texts match nothing. Repeated rows give repeated windows. Up to
    WINDOW_LIMIT item windows their hashes go along with the tasks and thin the document
    windows before the join; beyond, the hashes of all document windows are shuffled to those
    of the items, and the words of the hits alone are read again. The
    names of the roster go along in any case; more than NAME_LIMIT are an error. With
    ``decimals``, windows are of twelve words of which a decimal is one.
    """
    names = roster.select(F.explode(F.array("given_name", "family_name")).alias("w")).dropna().distinct()
    names = sorted({w for r in budget(names, NAME_LIMIT).collect() for w in words(r["w"])})
    wins = cut(item_windows(items, names, decimals))
    small = wins.count() <= WINDOW_LIMIT
    sizes = sorted(r["n"] for r in wins.select("n").distinct().collect())  # 1 to WINDOW
    vocabulary = wanted = None
    if small:
        rows = wins.select("h", "n").distinct().collect()
        wanted = {n: np.array(sorted(r["h"] for r in rows if r["n"] == n), np.int64) for n in sizes}
        vocabulary = sorted(r["w"] for r in wins.select(F.explode("words").alias("w")).distinct().collect())
    if small:
        found = document_windows(docs, names, sizes, vocabulary, wanted, decimals)
    else:
        hits = document_hashes(docs, names, sizes, decimals).join(wins.select("h", "n").distinct(), ["h", "n"], "left_semi").distinct()
        found = fetched_windows(docs, hits, names, decimals)
    right = wins.select("item_id", "h", "n", F.col("words").alias("item_words"))
    both = found.join(F.broadcast(right) if small else right, ["h", "n"])
    slots = F.filter(F.arrays_zip(F.col("item_words").alias("i"), F.col("words").alias("d")), lambda z: z["i"] != z["d"])
    pairs = F.array_distinct(F.arrays_zip(F.col("item_words").alias("i"), F.col("words").alias("d")))
    both = both.withColumn("verbatim", F.size(slots) == 0)
    both = both.withColumn("consistent", F.size(pairs) == F.size(F.array_distinct("item_words")))
    return both.select("doc_id", "item_id", "pos", "n", "verbatim", "consistent")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("documents", "eval_items", "lab_roster"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return leaks(*_tables(spark, sf_dir)).filter("verbatim").select("doc_id", "item_id").distinct()


def leak_counts(docs: DataFrame, items: DataFrame, roster: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_verbatim, n_reparameterised, first_word``, by the places at which windows begin.

    A window read with whole decimals counts where no verbatim one begins.
    """
    plain = leaks(docs, items, roster).filter("verbatim or consistent").select("doc_id", "item_id", "pos", "n", "verbatim", F.lit(False).alias("whole"))
    whole = leaks(docs, items, roster, decimals=True).filter("consistent and not verbatim").select("doc_id", "item_id", "pos", "n", "verbatim", F.lit(True).alias("whole"))
    same, other = F.bool_or("verbatim"), F.bool_or(~F.col("verbatim") & ~F.col("whole"))
    at = plain.unionByName(whole).groupBy("doc_id", "item_id", "pos").agg(same.alias("same"), (other | (F.bool_or("whole") & ~same)).alias("other"))
    return at.groupBy("doc_id", "item_id").agg(F.count_if("same").alias("n_verbatim"), F.count_if("other").alias("n_reparameterised"), F.min("pos").alias("first_word"))


def p8_leaks(spark, sf_dir: str) -> DataFrame:
    """Documents and items with the number of verbatim and of re-parameterised windows."""
    return leak_counts(*_tables(spark, sf_dir))
