import random
from collections import defaultdict

from tidemark.llm import packing as P

DOCS = "doc_id long, text string, item string, size long, part string"


def doc(i, text):
    return (i, text, "clash", 1, "x")


def placed(rows, docs, capacity=64):
    return P.containers(rows(docs, DOCS), capacity, 8).collect()


def test_every_text_whole_and_containers_hold(rows):
    r = random.Random(0)
    docs = [doc(i, "word " * r.randint(0, 40)) for i in range(300)] + [doc(900, None), doc(901, ""), doc(902, "long text " * 200), doc(903, "€äß 漢字 " * 3)]
    got = placed(rows, docs + docs[:30])
    enc = P.encoder(P.TOKENIZER)
    want = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, *_ in docs}
    per_doc, per_bin = defaultdict(list), defaultdict(int)
    for x in got:
        per_doc[x["doc_id"]].append(x)
        if x["container_id"] is not None:
            per_bin[x["container_id"]] += x["n_tokens"]
    assert set(per_doc) == set(want)
    assert all(sum(x["n_tokens"] for x in per_doc[i]) == n for i, n in want.items())
    assert all(len(per_doc[i]) == max(1, -(-n // 64)) for i, n in want.items())
    assert all((x["container_id"] is None) == (x["n_tokens"] == 0) for x in got)
    assert max(per_bin.values()) <= 64
    for i, n in want.items():
        spans = sorted((x["token_start"], x["n_tokens"]) for x in per_doc[i] if n)
        assert all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:]))
    assert sum(per_bin.values()) / (64 * len(per_bin)) > 0.9


def test_same_containers_whatever_the_input_order(rows):
    r = random.Random(1)
    docs = [doc(i, "word " * r.randint(1, 40)) for i in range(200)]
    key = lambda x: (x["doc_id"], x["piece"], x["container_id"])
    assert sorted(map(key, placed(rows, docs))) == sorted(map(key, placed(rows, docs[::-1])))


def test_many_partitions_still_fill(rows, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_PARTITION", 20)
    r = random.Random(2)
    got = placed(rows, [doc(i, "word " * r.randint(1, 30)) for i in range(300)])
    fill = defaultdict(int)
    for x in got:
        fill[x["container_id"]] += x["n_tokens"]
    assert max(fill.values()) <= 64 and sum(fill.values()) / (64 * len(fill)) > 0.85


def test_empty(rows):
    assert placed(rows, []) == []
    assert [tuple(x)[2:] for x in placed(rows, [doc(1, None)])] == [(0, 0, 0, None)]


def test_best_fit_equals_search():
    """The bitset finds what a scan over the open containers finds."""
    r = random.Random(3)
    fit, free, opened = P.BestFit(50, 6), {}, 0
    for _ in range(3000):
        size = r.randint(1, 50)
        got = fit.put(size)
        fitting = [f for f in free.values() if f >= size]
        if fitting:
            assert got in free and free[got] == min(fitting)
        else:
            if len(free) == 6:
                low = min(free.values())
                gone = set(free) - fit.still_open() - {got}
                assert len(gone) == 1 and free[next(iter(gone))] == low
                del free[next(iter(gone))]
            assert got == opened
            opened += 1
            free[got] = 50
        free[got] -= size
        if not free[got]:
            del free[got]
        assert fit.still_open() == set(free)
