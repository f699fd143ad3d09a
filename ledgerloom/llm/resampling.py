"""Resampling of documents towards a target distribution of hashed n-grams (operator 13).

Texts are counted in batches: the texts of a batch are joined with sentinels between them, one pattern pass finds all
words, and a search of the word places in the documents' offsets tells which runs of words cross from one document to the
next, which are masked out of the count. The checksum of a run of words comes from the checksums of its words, since
crc32 is linear: the words before are moved by the length of what follows, with tables. Each task counts in one array,
so only buckets are shuffled and gathered, as many as there are buckets. A second pass weighs each document, and the drawn
ones are ranked by prefix sums over a range sort.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.sentence_pieces import steps
from ledgerloom.operators.numbering import numbered
from ledgerloom.session import durable

BUCKETS = 10_000
#: Words of the longest run that is a feature.
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Between documents. No word has it, so no word crosses.
SENTINEL = b"\n"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words that one step of the pattern pass holds as Python objects.
FOUND = 1 << 18


def _zeros() -> np.ndarray:
    """tables[k][j][b]: what byte j of a checksum becomes when 2^k zero bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]
    one = np.zeros((4, 256), np.uint32)
    for j in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        one[j] = (value >> np.uint32(8)) ^ step[value & np.uint32(0xFF)]
    out = [one]
    while len(out) < 32:
        out.append(np.stack([moved(row, out[-1]) for row in out[-1]]))
    return np.stack(out)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums with one table applied."""
    return by[0][crc & 0xFF] ^ by[1][crc >> 8 & 0xFF] ^ by[2][crc >> 16 & 0xFF] ^ by[3][crc >> 24]


TABLES = _zeros()
#: The same for each number of bytes up to 63, flat, so that all common words take one step.
SHORT = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
for _n in range(1, 64):
    SHORT.append(np.stack([moved(row, TABLES[0]) for row in SHORT[-1]]))
SHORT = np.stack(SHORT).reshape(-1)


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksums' share in that of a text with ``size`` more bytes behind."""
    base = np.minimum(size, 63) << 10
    out = SHORT[base + (crc & 0xFF)] ^ SHORT[base + 256 + (crc >> 8 & 0xFF)] ^ SHORT[base + 512 + (crc >> 16 & 0xFF)] ^ SHORT[base + 768 + (crc >> 24)]
    rest = np.maximum(size - 63, 0)
    for k in range(int(rest.max(initial=0)).bit_length()):
        has = np.flatnonzero(rest >> k & 1)
        out[has] = moved(out[has], TABLES[k])
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, length and crc32 of each word of the joined texts, A-Z lower-cased, in order."""
    joined = SENTINEL.join(texts).translate(LOWER)
    offsets = np.cumsum([0] + [len(t) + len(SENTINEL) for t in texts])
    found, start, size, crc = WORD.finditer(joined), [], [], []
    while part := list(islice(found, FOUND)):
        words = [m.group() for m in part]
        start.append(np.array([m.start() for m in part], np.int64))
        size.append(np.array(list(map(len, words)), np.int64))
        crc.append(np.array(list(map(zlib.crc32, words)), np.uint32))
    if not start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.searchsorted(offsets, np.concatenate(start), "right") - 1, np.concatenate(size), np.concatenate(crc)


def features(texts: list[bytes], buckets: int = BUCKETS, run: int = RUN):
    """(document of each feature, its bucket) for runs of 1, 2, ... words, and the words of each document."""
    doc, size, crc = words_of(texts)
    out = [(doc, (crc % buckets).astype(np.int64))]
    # a word with the blank before it, as it stands behind another
    blank = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
    whole = crc
    for n in range(1, run):
        # the text so far moves in front of a blank and the next word; runs that cross documents are masked
        whole = shifted(whole[:-1], size[n:] + 1) ^ blank[n:]
        inside = doc[n:] == doc[: len(doc) - n]
        out.append((doc[n:][inside], (whole[inside] % buckets).astype(np.int64)))
    return out, np.bincount(doc, minlength=len(texts))


def encoded(texts) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """bucket, n: how many features of all rows of ``texts`` (text) fall into each bucket that has any."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, part in steps(batches):
            for _, bucket in features(encoded(part), buckets, run)[0]:
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    return texts.select(F.lit(0).alias("none"), "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Gain of each bucket: a thousandth of a nat for each unit, rounded down. One row a bucket comes to the driver."""
    own, aim = bucket_counts(docs, buckets, run).withColumnRenamed("n", "s"), bucket_counts(target, buckets, run).withColumnRenamed("n", "t")
    # both sums are over the counts, one row a bucket at most
    both = durable(own.join(aim, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * float(total["s"] + buckets) / ((s + 1) * float(total["t"] + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of ``docs``."""
    buckets = len(gain)

    def weigh(batches):
        for ids, texts in steps(batches):
            parts, words = features(encoded(texts), buckets, run)
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for doc, bucket in parts:
                n += np.bincount(doc, minlength=len(texts))
                # exact sums: the documents are in order, so each has a run of the running sum
                sums = np.append(0, np.cumsum(gain[bucket]))
                edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                weight += sums[edge[1:]] - sums[edge[:-1]]
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    ``target`` has a text column. ``percent`` of the rows with at least ``least`` words are drawn, those of the highest
    scores; of equal scores the smaller doc_id goes first, a null id last, then fewer features, then the smaller weight.
    Rows that repeat each other are drawn each for itself. A null text counts as empty and has no features; a null id's
    noise is that of an empty id. Without a target every gain follows the documents' own counts. Other columns are not read.
    """
    gain = gains(docs, target, buckets)
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((first + 0.5) / 4294967296)))
    scored = durable(weighed(docs, gain).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least
    drawn = scored.agg(F.floor(percent * F.count(F.when(able, 1)) / 100)).first()[0]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = numbered(scored.filter(able), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH tab AS (SELECT list(list_reduce([0,0,0,0,0,0,0,0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k::BIGINT) ORDER BY k) AS crcs FROM range(256) r(k)),
split AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL SELECT 'b', NULL, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k+1]), list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k+1] || ' ' || w[k+2]))) AS feature FROM split),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM hexed, tab),
fb AS (SELECT kind, id, bucket FROM f JOIN b USING (feature)),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM fb GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
wt AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM fb JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
sc AS (SELECT s.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || s.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM split s LEFT JOIN wt ON s.id = wt.id WHERE kind = 'd'),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN rk ON sc.doc_id = rk.doc_id
"""
