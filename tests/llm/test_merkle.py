"""Operator 12 against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest
from tests.llm.conftest import ODD

from ledgerloom.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, width=16):
    """Root of the digests, and the sides of each one's path."""
    sides = [[] for _ in digests]
    at, level = list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[k : k + width] for k in range(0, len(level), width)]
        for n, p in enumerate(at):
            run, k = runs[p // width], p % width
            sides[n].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[n] = p // width
        level = ["".join(r) for r in runs]
        level = [H(r) for r in level]
    return level[0], sides


def expected(rows, lower):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built, subs = {}, []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, sides = tree([leaf(r) for r in own])
        built[s] = (own, sub, sides)
        subs.append(sub)
    root, above = tree(subs)
    out = []
    for k, s in enumerate(names):
        own, sub, sides = built[s]
        for r, side in zip(own, sides):
            path = side + above[k]
            shown = r if not lower(r) or r[4] is None else (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            digest = leaf(shown)
            for a, b in path:
                digest = H(a + digest + b)
            out.append((r[0], leaf(r), sub, root, H("".join(a + b for a, b in path)), digest, digest == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, place long, n long, group string, path string"


def check(spark, rows):
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import lower_ascii, remainder

    df = spark.createDataFrame([(*r, "x", 1, 2, "g", "p") for r in rows], SCHEMA).repartition(5)
    got = merkle.verified(df, F.when(remainder(F.col("doc_id"), 5) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    want = expected(rows, lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_odd_rows(spark):
    rows = [(i, s, None if k % 3 else "en", k or None, t) for s in (None, "", "a", "é") for k, (i, t) in enumerate(ODD)]
    check(spark, rows + [(9, "alone", "en", 1, "One ROW")])
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, "only", "en", 3, "Abc")])


@pytest.mark.parametrize("n", [17, 4097])
def test_sizes_around_runs_and_blocks(spark, n):
    check(spark, [(k, "hot", "en", k, f"Text {k}") for k in range(n)] + [(k, f"s{k % 40}", None, k, None) for k in range(100)])


def test_many_sources(spark):
    rng = random.Random(1)
    check(spark, [(k, f"s{rng.randint(0, 5000)}", "en", k, f"T{k}") for k in range(6000)])
