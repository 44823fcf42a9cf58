import random

import pytest

from tidemark.llm import leakage as L

DOCS, ITEMS, ROSTER = "doc_id long, text string, n int, h long, words string", "item_id long, item_text string, pos int", "given_name string, family_name string"
VOCAB = "the cell lost 5 7 percent after hours of cycling at v degrees anna berg kemal ilm gauge slope run rig".split()


def run(rows, docs, items, roster=(("Anna", "Berg"), ("Kemal", None))):
    return L.leaks(rows([(i, t, 1, 2, "x") for i, t in docs], DOCS), rows([(i, t, 0) for i, t in items], ITEMS), rows(list(roster), ROSTER))


def verbatim(df):
    return {(r["doc_id"], r["item_id"]) for r in df.filter("verbatim").collect()}


def brute(docs, items):
    out = set()
    for i, t in items:
        w = L.words(t) if t else []
        n = min(12, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, u in docs:
            x = L.words(u) if u else []
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)) and grams:
                out.add((d, i))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(rows, monkeypatch, small):
    if not small:
        monkeypatch.setattr(L, "WINDOW_LIMIT", 3)
    r = random.Random(0)
    text = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    items = [(i, text(r.choice([3, 8, 11, 12, 13, 30]))) for i in range(25)] + [(100, None), (101, "  ... "), (102, "")]
    docs = []
    for d in range(120):
        t = text(r.randint(0, 60))
        if d % 3 == 0:
            w = r.choice(items[:25])[1].split()
            k = r.randint(0, max(0, len(w) - 12))
            t += " " + "; ".join(w[k : k + r.choice([5, 11, 12, 20])]).upper() + ". " + text(4)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "x " * 50_000)]
    got = verbatim(run(rows, docs, items))
    assert got == brute(docs, items) and len(got) > 20


def test_reading_of_words():
    assert L.words("Cu​t­off ｆｕｌｌ Straße_x 5²") == ["cutoff", "full", "straße", "x", "52"]


def test_decimals_are_one_slot(rows):
    item = "the cell fell from 38.5 to 38.9 volts after 29.7 hours, then the gauge rose by 4 percent in the next run"
    docs = {
        1: item.replace("38.5", "40.1").replace("38.9", "41.3"),  # two decimals share a part
        2: item.replace("29.7", "30"),
        3: item.replace("by 4 percent", "by 4,5 percent").replace("29.7", "31"),
        4: item.replace("38.5", "40.1").replace("38.9", "40.1"),  # still one value for each
        5: "x 1.5 " + item,
        6: "nothing of it",
    }
    t = lambda d, kind: rows([(i, x, 1, 2, "x") if kind == DOCS else (i, x, 0) for i, x in d.items()], kind)
    got = {r["doc_id"]: r for r in L.leak_counts(t(docs, DOCS), t({1: item}, ITEMS), rows([("Anna", "Berg")], ROSTER)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert all(got[i]["n_reparameterised"] > 0 and got[i]["first_word"] == 0 for i in (1, 2, 3, 4))
    assert (got[5]["n_reparameterised"], got[5]["first_word"]) == (0, 3)
    twice = "the cell fell from 38.5 to 38.5 volts after 29.7 hours, then the gauge rose"
    odd = {1: twice.replace("38.5", "40.1", 1).replace("38.5", "41.3").replace("29.7", "30")}
    assert L.leak_counts(t(odd, DOCS), t({1: twice}, ITEMS), rows([("Anna", "Berg")], ROSTER)).count() == 0


def test_changed_slots_are_reported_apart(rows):
    item = "Anna measured 5 volts at cell 5 and then 9 hours later the gauge fell by 5 percent"
    swapped = "Kemal measured 7 volts at cell 7 and then 2 hours later the gauge fell by 7 percent"
    mixed = "Kemal measured 7 volts at cell 8 and then 2 hours later the gauge fell by 6 percent"
    got = {(r["doc_id"], r["verbatim"], r["consistent"]) for r in run(rows, [(1, item), (2, swapped), (3, mixed)], [(1, item)]).collect()}
    assert (1, True, True) in got and (2, False, True) in got
    assert not any(v for d, v, _ in got if d != 1) and (3, False, False) in got


def test_eleven_words_are_too_few(rows):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, " ".join(f"w{i}" for i in range(11))), (2, " ".join(f"w{i}" for i in range(3, 15)))]
    assert verbatim(run(rows, docs, [(1, item)])) == {(2, 1)}


def test_empty(rows):
    assert run(rows, [], [(1, "a b")]).count() == 0
    assert run(rows, [(1, "a b")], []).count() == 0
    assert run(rows, [(1, "a b")], [(1, "a b")], ()).count() == 1


def test_reparameterised_items_are_found(spark, rows, data):
    """Every evaluation item with other numbers, names and units, planted in other text: recall of at least 0.9."""
    items = [(r["item_id"], r["item_text"]) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    roster = [(r["given_name"], r["family_name"]) for r in spark.read.parquet(f"{data}/lab_roster.parquet").collect()]
    rng = random.Random(3)
    others = [w.lower() for pair in roster for w in pair if w]
    units, known = sorted(L.UNITS), set(others)

    def changed(text):
        swap, out = {}, []
        for w in L.words(text, decimals=True):
            if w not in swap:
                if L._number(w):
                    swap[w] = str(rng.randint(100_000, 999_999) + len(swap)) if w.isdigit() else f"{rng.randint(100, 999)}.{rng.randint(1000, 9999)}"
                else:
                    swap[w] = rng.choice(others) if w in known else rng.choice(units) if w in units else w
            out.append(swap[w])
        return " ".join(out)

    planted = [(k, f"some words before {changed(t)} and some after", t) for k, (_, t) in enumerate(items)]
    moved = {k for k, d, t in planted if " ".join(L.words(t, decimals=True)) not in d and any(L._number(w) for w in L.words(t, decimals=True))}
    docs = rows([(k, d, 1, 2, "x") for k, d, _ in planted], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in L.leak_counts(docs, rows([(i, t, 0) for i, t in items], ITEMS), rows(roster, ROSTER)).filter("n_reparameterised > 0 or n_verbatim > 0").collect()}
    hit = sum((k, items[k][0]) in got for k in moved)
    assert len(moved) > 50 and hit / len(moved) >= 0.9
