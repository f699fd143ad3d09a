"""Operators 7 and 8 against the tokenizer's own library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD

from ledgerloom.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def units():
    return bpe.Units(PATH, limit=300)


def odd_texts(n, seed):
    rng = random.Random(seed)
    pool = "ab'sre ll  \n\n\t.,!1é中\xa0\x1c\x85 <|ſ٣\0"
    return ["".join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(["<|endoftext|>", " the", "'re", "'ll", "tion"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library(units):
    for text in odd_texts(4000, 1):
        assert units.text_ids(text).tolist() == units.encode(text)


def test_counts_by_the_program_are_those_of_the_library():
    counts = bpe.UnitCounts(PATH, limit=300, pairs=50)
    words = ["antidisestablishmentarianism", " 中文字é", "x" * 700, "don't we'll", "04dbebab91ab85687d33", "und.34@mail7.example.com", "a<|endoftext|>b"]
    for text in [*words, *odd_texts(4000, 5)]:
        assert int(counts.prefix(text)[1][-1] if text else 0) == len(counts.encode(text)), text
    assert not counts.ids and len(counts.known) <= 320


def test_units_that_recur_outlive_a_full_cache():
    few = bpe.Units(PATH, limit=20)
    for k in range(60):
        assert few.text_ids(f"the same {k} words").tolist() == few.encode(f"the same {k} words")
    assert " same".strip() in few.known and len(few.known) <= 24 and "3" not in few.known


def test_truncation_finds_the_longest_prefix(units):
    for k, text in enumerate(odd_texts(400, 2)):
        budget = k % 7
        assert units.truncate(text, budget) == max(n for n in range(len(text) + 1) if len(units.encode(text[:n])) <= budget)


def test_counts_of_odd_rows(documents, units):
    got = token_counts.prefix_counts(documents(ODD), PATH).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), len((t or "").encode()), len(units.encode(t or ""))) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.prefix_tokens[-1] if r.prefix_tokens else 0) for r in got) == want
    for r in got:
        assert r.fit_chars <= 10**6 and list(r.prefix_chars) == sorted(r.prefix_chars)
    assert token_counts.prefix_counts(documents([]), PATH).count() == 0


def packed(df):
    seqs = defaultdict(list)
    for r in df:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return seqs


def test_pieces_and_sequences_of_odd_rows(documents, units):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)]
    got = packing.packed_documents(documents(rows), PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, t in rows:
        ids, at = units.encode(t or "") + [2], 0
        pieces = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 1024)
        for r in pieces:
            part = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and zlib.crc32(part.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    packed(got)
    assert packing.packed_documents(documents([]), PATH).count() == 0


def test_rounds_of_open_bins_pack_tightly(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 1024) for _ in range(6000)]
    rows = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(6)
    got = packing.pack(rows, most=64, share=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    assert len(packed(got)) <= 1.12 * sum(sizes) / 1024


def test_bounded_best_fit_is_that_of_a_plain_list():
    rng = random.Random(8)
    for most in (1, 3, 40):
        heap, plain, n = packing.BestFit(64, most), [], 0  # plain: [bin, free] in order of their last change
        for _ in range(3000):
            need = rng.randint(1, 64)
            fits = [x for x in plain if x[1] >= need]
            closed = None
            if fits:
                free = min(f for _, f in fits)
                want = [x for x in fits if x[1] == free][-1]
                plain.remove(want)
            else:
                want = [n, 64]
                if len(plain) >= most:
                    fullest = min(f for _, f in plain)
                    gone = [x for x in plain if x[1] == fullest][-1]
                    plain.remove(gone)
                    closed = gone[0]
            if want[1] > need:
                plain.append([want[0], want[1] - need])
            assert heap.add(need, n) == (want[0], 64 - want[1], closed)
            n += want[0] == n
        assert heap.left() == dict(map(tuple, plain))


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    heap = packing.BestFit(10, 2)
    assert [heap.add(n, k)[:2] for k, n in enumerate((7, 5))] == [(0, 0), (1, 0)]
    assert heap.add(3, 2)[:2] == (0, 7)
    assert heap.add(8, 3) == (3, 0, None)
    assert heap.add(9, 4) == (4, 0, 3)
    assert heap.left() == {1: 5, 4: 1}
