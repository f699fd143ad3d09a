"""Operator 11 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD

from ledgerloom.llm import piece_bpe, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
POOL = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "中", "😀", "in", "er", "on", "re", "<0x41>", "</s>", "\0", "A", "1", "。", " " * 10, "xxx", "�", "\xa0", "ing", "ation"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def odd_texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    return made + [" " * k for k in range(100)] + ["a" * k for k in range(100)] + [" " * 3000 + "x" + " " * 77, letters, "ab" * 3000]


@pytest.mark.parametrize("limit", [40, 100_000])
def test_ids_and_texts_are_those_of_the_library(library, limit):
    p, texts = piece_bpe.Pieces(PATH, limit=limit), odd_texts(3000, 1)
    for k in range(0, len(texts), 400):
        part, at = texts[k : k + 400], 0
        flat, sizes = p.encode(part)
        for text, n, back in zip(part, sizes.tolist(), p.decode(flat, sizes)):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert flat[at : at + n].tolist() == want
            assert back.decode() == library.decode(want)
            at += n


def test_decoding_of_any_ids_is_that_of_the_library(library):
    p, rng = piece_bpe.Pieces(PATH), random.Random(2)
    likely = [0, 1, 2, 259, 260, 263, 300, 500, 29871, 31000] * 20 + list(range(3, 259))
    for _ in range(3000):
        ids = [rng.choice(likely) for _ in range(rng.randint(0, 9))]
        assert p.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids)


def test_rounds_equal_one_merge_after_the_other_where_longer_pieces_rank_lower(library):
    """A small made-up vocabulary in which merging changes which pair is lowest."""
    rng = random.Random(3)
    for _ in range(30):
        p = piece_bpe.Pieces.__new__(piece_bpe.Pieces)
        made = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        vocab = [(c, k, 0.0) for k, c in enumerate("abc")] + [(w, 3 + k, -float(rng.randint(1, 12))) for k, w in enumerate(sorted(made))]
        p.pairs(vocab, len(vocab))
        number, score = {w: k for w, k, _ in vocab}, {w: s for w, _, s in vocab}
        for _ in range(60):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 90)))
            parts = list(word)
            while True:
                pairs = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if len(a + b) > 1 and a + b in score]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            codes = np.array([ord(c) for c in word], np.int64)
            first = p.symbol[codes]
            got, _ = p.merged(first.copy(), p.segments(codes, first, np.array([0])))
            assert got.tolist() == [number.get(w, -1) for w in parts]


def test_odd_rows(spark, documents, library):
    got = sentence_pieces.round_trip(documents(ODD), PATH).collect()
    want = [library.encode(t or "", add_bos=True, add_eos=True) for _, t in ODD]
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=key) == sorted(
        ((i, len(w), np.array(w, "<u4").tobytes(), library.decode(w)) for (i, _), w in zip(ODD, want)), key=key)
    assert sentence_pieces.round_trip(documents([]), PATH).count() == 0
    rows = spark.createDataFrame([(1, want[0], "c"), (None, None, "c"), (2, [], "c")], "doc_id long, ids array<int>, text string")
    assert sorted(sentence_pieces.decoded(rows, PATH).collect(), key=key) == sorted([(1, library.decode(want[0])), (None, ""), (2, "")], key=key)
    assert hashlib.sha256(bytes(got[0].ids)).hexdigest()
