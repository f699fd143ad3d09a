"""Operators 5 and 10 against brute force."""

import hashlib
import random
from collections import defaultdict

from tests.llm.conftest import ODD

from ledgerloom.llm import exact_dedup, graph, ngram_join
from ledgerloom.llm.exact_dedup import combine, fingerprints


def lower(t):
    return (t or "").encode().lower().decode()


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(9000))
    whole = fingerprints([data])[0]
    for cuts in ([0, 9000], [1, 1024, 5000], [3000, 3001, 8999]):
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 9000])]
        left = (0, 0, 0)
        for f in fingerprints(parts):
            left = combine(left, f)
        assert left == whole
    assert fingerprints([b"", b"\0", b"\0\0"]) == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]


def check_exact(rows, got):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = [r for r in got if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and str(kept[0].doc_id) == str(kept[0].keep_id)


def test_exact_groups_of_odd_rows(documents):
    check_exact(ODD, exact_dedup.exact_groups(documents(ODD)).collect())
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_large_groups_are_compared_in_levels(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART", 4)
    rows = [(k, "Hot Text" if k % 3 else f"text {k % 7}") for k in range(200)]
    check_exact(rows, exact_dedup.exact_groups(documents(rows)).collect())


def test_equal_fingerprints_of_unequal_texts_are_told_apart(documents, monkeypatch):
    # with multiples of the prime as powers, every text of a length has the same fingerprint
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda texts: [(0, 0, len(t)) for t in texts])
    rows = [(k, "abcd"[k % 4] * (5 + k % 2)) for k in range(40)] + [(99, "z")]
    check_exact(rows, exact_dedup.exact_groups(documents(rows)).collect())


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return sorted((str(i), len(sets[k]), str(min(low[find(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def near_copies(rng, n, words=60, changes=4, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(words)] = f"v{rng.randrange(50)}"
        out.append(" ".join(copy))
    return out


def test_links_of_near_copies(documents):
    rng = random.Random(5)
    line = " ".join(f"boiler{k}" for k in range(14))
    texts = [t for n in (2, 3, 12, 60) for t in near_copies(rng, n)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + line for _ in range(60)]
    texts += ["one two", "One  two", "one", "one", "a b c d", "a b c d e"] + [" ".join([line] * k) for k in (1, 2, 3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.joined(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_large_clusters_are_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "DENSE", 5)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rng = random.Random(6)
    # a chain: each links with its neighbours alone
    base = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(base[6 * k : 6 * k + 120])) for k in range(40)] + [(100 + k, t) for k, t in enumerate(near_copies(rng, 40, 40, 6))]
    got = ngram_join.joined(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_sets_of_all_small_sizes_keep_their_links(documents):
    for percent in (50, 70, 75, 80, 85, 90, 95):
        for n in range(1, 150):
            for m in range(1, n + 1):
                # the least overlap that links; the shared entries come last where they can
                both = -(-percent * (n + m) // (100 + percent))
                if both <= m:
                    (x, need), (y, less) = ngram_join.prefix(n, percent), ngram_join.prefix(m, percent)
                    assert min(both, x - (n - both), y - (m - both)) >= max(need, less), (percent, n, m)
    rows = []
    for n in range(1, 21):
        for m in range(max(1, n - 4), n + 1):
            for lead in range(n - m + 1):
                words = [f"p{len(rows)}x{k}" for k in range(n + 3)]
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[lead : lead + m + 3]))]
    got = ngram_join.joined(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_links_of_odd_rows(documents):
    got = ngram_join.joined(documents(ODD)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(ODD)
    assert ngram_join.joined(documents([])).count() == 0
    assert ngram_join.joined(documents([(1, None), (2, "")])).count() == 2


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 130)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
