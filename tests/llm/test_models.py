"""Operators 3 and 9, and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from ledgerloom.llm import decontaminate, lm_scoring, ngram_trie, toxicity
from ledgerloom.llm.ngram_trie import EliasFano, NgramTrie, windows


def test_elias_fano_gives_back_its_values():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (5, 3), (1000, 10), (1000, 10**9), (3000, 2**40), (70, 64)):
        v = np.sort(rng.integers(0, top, n))
        assert (EliasFano.of(v)[np.arange(n)] == v).all()


def test_trie_agrees_with_plain_counting():
    rng = np.random.default_rng(1)
    kinds, start, end, bits = 9, 8, 7, 5
    seqs = [np.concatenate(([start], rng.choice(7, rng.integers(0, 30), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]), [end])) for _ in range(60)]
    tokens = np.concatenate(seqs)
    single, keys, counts = np.bincount(tokens, minlength=kinds), [], [{(k,): n for k, n in enumerate(np.bincount(tokens, minlength=kinds).tolist())}]
    for k in (2, 3, 4):
        u, c = np.unique(windows(tokens, bits, k, start), return_counts=True)
        keys.append((u[c > 1], c[c > 1]))
        counts.append({tuple(x >> bits * (k - 1 - j) & 31 for j in range(k)): n for x, n in zip(*(v.tolist() for v in keys[-1]))})
    trie = NgramTrie.from_buffer(NgramTrie.build(kinds, bits, start, single, keys).to_bytes())
    got = trie.log10(tokens)

    def p(w, h):
        if not h:
            return counts[0][(w,)] / (sum(counts[0].values()) - counts[0][(start,)]) if w != start else 0.0
        seen = counts[len(h) - 1].get(h)
        if not seen:
            return p(w, h[1:])
        after = {g: n for g, n in counts[len(h)].items() if g[:-1] == h}
        left = 1 - sum((n - ngram_trie.DISCOUNT) / seen for n in after.values())
        return (max(after.get((*h, w), 0) - ngram_trie.DISCOUNT, 0)) / seen + left * p(w, h[1:])

    at = 0
    for s in seqs:
        for k in range(1, len(s)):
            want = math.log10(p(int(s[k]), tuple(int(x) for x in s[max(0, k - 3) : k])))
            assert want - 0.2 < got[at + k] <= want + 1e-9
        at += len(s)
    for h in [(start,), (0,), (0, 1), (5, 5), (1, 0, 0)]:
        assert abs(sum(p(w, h) for w in range(kinds)) - 1) < 1e-9


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def test_scores_of_texts(documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 3000)
    rng = random.Random(7)
    rows = ODD + [(1000 + k, " ".join(rng.choice(["the", "of", "and"] + [f"r{rng.randrange(3000)}"]) for _ in range(rng.randrange(80)))) for k in range(300)]
    got = lm_scoring.scored(documents(rows), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).collect()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 4)) for (i, _), ws in zip(rows, tokens))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    new = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 1000]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert lm_scoring.scored(documents([]), F.lit(False)).count() == 0


def test_scores_are_those_of_all_words_and_ngrams(documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 900)
    monkeypatch.setattr(lm_scoring, "PER_SHARD", 50)
    rng = random.Random(8)
    # rare words beside a hot one, which had a share under 1e-4 and their n-grams under 1e-6
    rows = [(k, "hot " * 3000) for k in range(12)] + [(100 + k, " ".join(f"r{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(60)))) for k in range(60)]
    rows += [(200, "r1 r2 never r1 r2"), (201, ""), (202, None)]
    got = {r.doc_id: r for r in lm_scoring.scored(documents(rows), F.col("doc_id") % 5 == 1).collect()}
    texts = {i: ["<s>", *(t or "").split(), "</s>"] for i, t in rows}
    grams = [Counter(tuple(w[k : k + m]) for i, w in texts.items() if i % 5 != 1 for k in range(len(w) - m + 1)) for m in (1, 2, 3)]
    words = {w: n for (w,), n in grams[0].items() if w not in ("<s>", "</s>")}
    once, twice = (sum(n == k for n in words.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    total = sum(words.values()) + grams[0]["</s>",]

    def p(h, w):
        if not h:
            return (grams[0]["</s>",] if w == "</s>" else words[w] - d if w in words else d * len(words)) / total
        after = {g[-1]: n for g, n in grams[len(h)].items() if g[:-1] == h}
        kept = {x: n for x, n in after.items() if n >= 2}
        seen = sum(after.values()) or 1
        left = 1 - sum(n - ngram_trie.DISCOUNT for n in kept.values()) / seen
        return (kept[w] - ngram_trie.DISCOUNT if w in kept else 0) / seen + left * p(h[1:], w)

    for i, w in texts.items():
        if i >= 100:
            want = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
            assert want - 0.05 * len(w) < got[i].score < want + 1e-6, (i, want, got[i].score)
    empty = lm_scoring.scored(documents([(1, ""), (2, None), (3, " ")]), F.col("doc_id") == 1).collect()
    assert len(empty) == 3 and all(math.isfinite(r.score) for r in empty)


def char_model():
    return toxicity.CharModel(Counter(g for w, n in (("idiot", 50), ("stupid", 40), ("the", 90), ("loser", 30)) for g in [f"^^{w}$"[k : k + 3] for k in range(len(w) + 1)] for _ in range(n)))


@pytest.mark.parametrize("text, word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("5tup!d", "stupid"), ("the", "the"), ("l0$er", "loser")])
def test_disguised_words_are_restored(text, word):
    assert toxicity.decode(text, char_model()) == word
    assert word in toxicity.Restorer(char_model()).words(f"and {text}, so")


@pytest.mark.parametrize("text, word", [("iidiot", "idiot"), ("sttuuppiidd", "stupid"), ("st up id", "stupid"), ("id i ot", "idiot"), ("i d io t", "idiot"), ("stu pid", "stupid"), ("st-up-id", "stupid"), ("st - up. id", "stupid"), ("id.i ot", "idiot"), ("ii dd ii oo tt", "idiot"), ("stup id", "stupid"), ("s tupid", "stupid"), ("idio t", "idiot"), ("l oser", "loser"), ("stupi d", "stupid"), ("st_upid", "stupid"), ("5tup 1d", "stupid")])
def test_doubled_letters_and_pieces_are_restored(text, word):
    assert word in toxicity.Restorer(char_model()).words(f"and {text}, so")
    assert toxicity.Restorer(char_model()).words(f"{text} the {text}")[word] == 2


def test_long_runs_are_decoded_in_one_pass():
    got = toxicity.Restorer(char_model()).words(" ".join("i d i o t".split() * 400))
    assert got == {"idiot": 400, "i": 800, "d": 400, "o": 400, "t": 400}


def test_decoding_finds_the_likeliest_path_of_all():
    model, rng = char_model(), random.Random(3)

    def cost(path):
        state, total = "^^", 0.0
        for written, price in path:
            total -= price
            for c in written:
                if c == " " and state == "^^":
                    continue
                total += model(state + ("$" if c == " " else c))
                state = "^^" if c == " " else state[1] + c
        return total + (model(state + "$") if state != "^^" else 0.0)

    for _ in range(400):
        text = "".join(rng.choice("idotsule013! .") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 8)))
        best: dict = {}
        for path in itertools.product(*map(toxicity.ways, toxicity.runs(text))):
            read = "".join(w for w, _ in path)
            best[read] = max(cost(path), best.get(read, -math.inf))
        top = max(best.values())
        for known in (None, {}):
            assert best[toxicity.decode(text, model, known)] > top - 1e-9
    # a lattice in stretches, whose readings are kept, is the same as one in a whole
    known: dict = {}
    for _ in range(2000):
        text = "".join(rng.choice("idotsule01! ") * rng.choice((1, 1, 1, 1, 2)) for _ in range(rng.randrange(1, 25)))
        assert toxicity.decode(text, model, known) == toxicity.likeliest(toxicity.runs(text), model)


def test_real_double_letters_and_short_words_stay():
    words = ("happy", 40), ("all", 60), ("in", 80), ("the", 90), ("of", 80), ("it", 50)
    model = toxicity.CharModel(Counter(g for w, n in words for g in [f"^^{w}$"[k : k + 3] for k in range(len(w) + 1)] for _ in range(n)))
    assert toxicity.Restorer(model).words("happy in all of it, the all") == Counter({"all": 2, "happy": 1, "in": 1, "of": 1, "it": 1, "the": 1})


def test_rare_trigrams_stay_in_the_character_model(documents):
    # over a million trigrams, so that a share of a millionth was more than one
    rows = [(k, "the loser " * 2500) for k in range(100)] + [(1000, "qz qx"), (1001, "stupid 中文 qz"), (None, None)]
    model = toxicity.char_model(toxicity.trigram_counts(documents(rows)))
    words = Counter(w for _, t in rows for w in (t or "").split())
    want = toxicity.CharModel(Counter(g for w in words for g in [f"^^{w}$"[k : k + 3] for k in range(len(w) + 1)] for _ in range(words[w])))
    assert want.total > 2_000_000 and model.total == want.total and model.one == want.one and model.single == want.single
    for gram in [*want.three, "^q中", "zzz", "$^^", "the", "qz^"]:
        assert abs(model(gram) - want(gram)) < 1e-12
    assert model.three["^qz"] == model.two["qz"] == 2 and model.pair["^中"] == 1


def planted(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(40)]
        toxic = rng.random() < 0.2
        for _ in range(3 * toxic):
            w[rng.randrange(40)] = rng.choice(["idiot", "Stupid,", "schw" + rng.choice("abcdefg") * 2])
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_texts_are_told_apart(documents, spark):
    docs, labels = planted(1200, 3)
    docs += [(5000, "wak 1d10t wbk"), (5001, "wak s t u p i d wbk"), (5002, None), (5003, ""), (None, "wak wbl"), (7, docs[7][1]), (5004, "wak " * 60_000)]
    frame = spark.createDataFrame([*labels, (None, 1), (9, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(documents(docs), frame).collect()}
    assert len(got) == len({i for i, _ in docs})
    out = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in out) >= 0.99 * len(out) and len(out) > 300
    assert got[5000].predicted == got[5001].predicted == 1
    assert got[5002].score == got[5003].score == 0 and got[None].predicted == got[5004].predicted == 0


def test_scores_without_labels_or_documents(documents, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(documents(ODD), none).collect()} == {0.0}
    assert toxicity.scored(documents([]), none).count() == 0


def test_stages_of_the_pipeline(documents, spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_decontaminate import brute

    docs, labels = planted(600, 8)
    item = " ".join(f"item{k}" for k in range(20))
    rng = random.Random(1)
    base = [f"n{rng.randrange(10**6)}" for _ in range(120)]
    docs += [(10_000 + k, " ".join(base[:60] + [f"edit{k}"] + base[61:])) for k in range(5)]
    docs += [(20_000 + k, f"Copy of {rng.randrange(1)} text") for k in range(4)] + [(20_003, "copy of 0 text"), (30_000, f"x {item} y"), (30_001, None), (30_002, ""), (None, "null id")]
    folder = str(tmp_path)
    documents(docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [now]
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.durable(stage(spark, now, folder), "stage")
        kept.append(now)
        if name != "best-fit packing":
            assert now.columns == kept[0].columns
    ids = [sorted(str(r.doc_id) for r in k.select("doc_id").collect()) for k in kept[:-1]]
    toxic = {str(i) for i, t in labels if t}
    assert len(set(ids[0]) - set(ids[1]) - toxic) == 0 and len(toxic & set(ids[1])) <= 0.05 * len(toxic)
    texts = dict((str(i), t) for i, t in docs)
    lower = [((texts[i] or "").lower()) for i in ids[2]]
    assert len(lower) == len(set(lower)) == len({(texts[i] or "").lower() for i in ids[1]}) and ids[2].count("20003") == 1
    assert set(ids[2]) - set(ids[3]) >= {str(10_001 + k) for k in range(4)} and "10000" in ids[3]
    dirty = {r[0] for r in brute([(int(i), texts[i]) for i in ids[3] if i != "None"], [(1, item)]) if r[2]}
    assert set(ids[3]) - set(ids[4]) == dirty == {"30000"}
    assert {str(r.doc_id) for r in kept[5].select("doc_id").collect()} == set(ids[4])
    assert corpus_pipeline.STAGES[3][1] is corpus_pipeline.benchmark and decontaminate.WINDOW == 10
