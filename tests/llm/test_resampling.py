"""Operator 13 against a plain count over Python lists."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tests.llm.conftest import ODD

from ledgerloom.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def expected(rows, target, least=20):
    docs = [(i, *runs(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, n, fs in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < 5 * len(able) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


def test_checksums_of_runs_come_from_those_of_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abZ 09é中\n.,_😀" + "q" * 4) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 300 + " " + "y" * 5000 + " " + "é" * 99]
    parts, words = resampling.features([t.encode() for t in texts])
    got = Counter((d, b) for doc, buckets in parts for d, b in zip(doc.tolist(), buckets.tolist()))
    assert got == Counter((k, bucket(f)) for k, t in enumerate(texts) for f in runs(t)[1])
    assert words.tolist() == [runs(t)[0] for t in texts]


def check(spark, documents, rows, target):
    aim = spark.createDataFrame([(t, "x", 1) for t in target], "text string, bucket string, n long")
    got = [tuple(r) for r in resampling.resampled(documents(rows).repartition(3), aim).collect()]
    assert sorted(got, key=str) == expected(rows, target)


def test_odd_rows_and_ties(spark, documents):
    rng = random.Random(2)
    made = [(k, " ".join(rng.choice(["alpha", "Beta", "gamma", "δ", "e5"]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    same = [(500, made[0][1] + " tail" * 30)] * 5 + [(None, "null id " * 20), (None, "null id " * 20)]
    check(spark, documents, ODD + made + same, ["Alpha beta gamma", None, "", "gamma δ δ"])
    check(spark, documents, ODD + made[:50], [])
    assert resampling.resampled(documents([]), documents([(1, "a")])).count() == 0
