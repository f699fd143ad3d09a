"""Operator 1 against brute force."""

import random
import re

from tests.llm.conftest import ODD

from ledgerloom.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = sorted({len(x) for x in windows})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), ",".join(sorted(str(f) for f in found if f is not None))))
    return sorted(out)


def got(documents, spark, docs, items):
    rows = decontaminate.hits(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in rows)


def test_windows_of_planted_items(documents, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 16)
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 7, 10, 11, 25])))) for k in range(25)]
    items += [(100, items[5][1].upper() + "!"), (100, items[6][1]), (None, items[7][1]), (101, None), (102, "..."), (9, items[9][1])]
    docs = []
    for k in range(60):
        w = [rng.choice(vocabulary) if rng.random() < 0.5 else f"x{rng.randrange(99)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = (items[rng.randrange(25)][1]).split()
        docs.append((k, rng.choice([" ", ", ", " - "]).join(w)))
    docs += ODD + [(200, items[3][1])] * 3
    assert got(documents, spark, docs, items) == brute(docs, items)


def test_no_items_or_documents(documents, spark):
    assert got(documents, spark, ODD, []) == brute(ODD, [])
    assert got(documents, spark, ODD, [(1, "..."), (2, None)]) == brute(ODD, [])
    assert got(documents, spark, [], [(1, "a b")]) == []


def test_a_benchmark_too_large_to_send_is_joined_by_shuffle(documents, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    items = [(1, "a b c d e f g h i j k l")]
    docs = [(1, "x a b c d e f g h i j k y"), (2, "a b c d e f g h i")]
    assert got(documents, spark, docs, items) == brute(docs, items)
