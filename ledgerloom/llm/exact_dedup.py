"""Exact deduplication by composable polynomial fingerprints (operator 5).

A text is hashed in chunks, each on its own: h = sum of byte * base^(bytes behind it) modulo a prime, for two primes.
Fingerprints of neighbours combine as h(AB) = h(A) * base^|B| + h(B), so the chunks of a huge text can be hashed
in any place and order. Texts with an equal fingerprint and length are then compared chunk by chunk, streaming
over sorted chunk rows, so no task holds more than two chunks. Large groups are compared in parts, then the parts'
first texts with each other, and so on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, table
from ledgerloom.session import durable

CHUNK = 1024
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_048_583_921, 1_299_709_173)
#: Bytes of a chunk in the comparison, and members of a group that one round compares with its first text.
COMPARED = 1 << 16
PART = 64


def powers(chunk: int = CHUNK) -> list[list[int]]:
    out = []
    for base, p in zip(BASES, PRIMES):
        row = [1]
        for _ in range(chunk):
            row.append(row[-1] * base % p)
        out.append(row)
    return out


POWERS = powers()


def shift(n: int, which: int) -> int:
    """base^n: the factor that moves a fingerprint in front of ``n`` more bytes."""
    return POWERS[which][n] if n <= CHUNK else pow(BASES[which], n, PRIMES[which])


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint (hash, hash, bytes) of two neighbours. Associative; (0, 0, 0) is the empty text."""
    a, b = ((left[k] * shift(right[2], k) + right[k]) % PRIMES[k] for k in (0, 1))
    return a, b, left[2] + right[2]


def _matrix() -> np.ndarray:
    """Powers for a full chunk, from the first byte on, in halves of 16 bits so that float sums stay exact."""
    cols = []
    for row in POWERS:
        p = np.array(row[:CHUNK][::-1], np.int64)
        cols += [p >> 16, p & 0xFFFF]
    return np.stack(cols, 1).astype(np.float64)


MATRIX = _matrix()


def chunk_hashes(data: np.ndarray) -> np.ndarray:
    """(n, 2) hashes of the rows of an (n, CHUNK) byte matrix; a short chunk has its zeros in front."""
    parts = (data.astype(np.float64) @ MATRIX).astype(np.int64)
    return np.stack([((parts[:, 2 * k] % PRIMES[k] << 16) + parts[:, 2 * k + 1]) % PRIMES[k] for k in (0, 1)], 1)


def fingerprints(texts: list[bytes]) -> list[tuple[int, int, int]]:
    """The fingerprint of each text, from hashes of its chunks."""
    sizes = [-(-len(t) // CHUNK) for t in texts]
    hashes, block, rows = [], bytearray(), 0
    for t in texts:
        # the first chunk takes the rest, so that all others are full
        block += bytes(-len(t) % CHUNK)
        block += t
        rows = len(block) // CHUNK
        if rows >= 1024:
            hashes.append(chunk_hashes(np.frombuffer(bytes(block), np.uint8).reshape(rows, CHUNK)))
            block = bytearray()
    if block:
        hashes.append(chunk_hashes(np.frombuffer(bytes(block), np.uint8).reshape(-1, CHUNK)))
    flat = np.concatenate(hashes).tolist() if hashes else []
    out, at = [], 0
    (p0, p1), s0, s1 = PRIMES, shift(CHUNK, 0), shift(CHUNK, 1)
    for t, n in zip(texts, sizes):
        a = b = 0
        for x, y in flat[at : at + n]:
            a, b = (a * s0 + x) % p0, (b * s1 + y) % p1
        at += n
        out.append((a, b, len(t)))
    return out


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, norm: the normalised text, and a key that tells rows with a repeated id apart by it."""
    norm = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("row_key"), "norm")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, row_key, fp_a, fp_b, n_bytes, text_sha256 of the text with A-Z lower-cased."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                fp = fingerprints(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([f[k] for f in fp], pa.int64()) for k in (0, 1, 2)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    names=["doc_id", "row_key", *FP, "text_sha256"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, row_key long, fp_a long, fp_b long, n_bytes long, text_sha256 string")


FP = ["fp_a", "fp_b", "n_bytes"]


def unequal_groups(members: DataFrame) -> DataFrame:
    """Fingerprints (fp_a, fp_b, n_bytes) that stand for more than one text, among ``members`` with their text.

    members: the fingerprint's columns, id, row_key, size (members of the group), norm.
    """
    found, level = None, members
    while True:
        parts = F.ceil(F.col("size") / PART).cast("long")
        dealt = level.withColumn("part", F.pmod(F.xxhash64("id", "row_key", "size"), parts))
        bad = durable(compare(dealt).distinct(), "unequal")
        found = bad if found is None else found.union(bad)
        # of large groups, the first text of each part goes on
        rest = dealt.filter(F.col("size") > PART)
        heads = durable(rest.groupBy(*FP, "part").agg(F.min(F.struct("id", "row_key")).alias("first")).select(*FP, "first.*"), "heads")
        if heads.isEmpty():
            return found.distinct()
        many = heads.groupBy(*FP).agg(F.count("*").alias("size"))
        level = durable(rest.drop("size", "part").join(heads, [*FP, "id", "row_key"], "left_semi").join(many, FP), "heads")


def compare(dealt: DataFrame) -> DataFrame:
    """Fingerprints of parts in which a text differs from the part's first text in some chunk."""

    def chunks(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = [b.column(c)[k].as_py() for c in range(7)]
                data = (row[6] or "").encode()
                for n, at in enumerate(range(0, len(data), COMPARED)):
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*row[:6], n)), pa.array([data[at : at + COMPARED]], pa.binary())], names=names)

    names = [*FP, "part", "id", "row_key", "chunk", "data"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", data binary"
    rows = dealt.select(*FP, "part", "id", "row_key", "norm").mapInArrow(chunks, schema)

    def differ(batches):
        key = first = None
        for b in batches:
            bad = []
            keys = list(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 6))))
            for k, data in zip(keys, b.column(7)):
                if k != key:
                    key, first = k, data.as_py()
                elif data.as_py() != first:
                    bad.append(k[:3])
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*bad)], names=FP)

    place = [*FP, "part", "chunk"]
    return rows.repartition(*place).sortWithinPartitions(*place, "id", "row_key").mapInArrow(differ, ", ".join(f"{c} long" for c in FP))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row_key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id
    stays. Rows that repeat an id and text count each, and the first alone is kept; null ids come after all others.
    """
    prints = durable(fingerprinted(docs).groupBy("doc_id", "row_key", *FP, "text_sha256").agg(F.count("*").alias("copies")), "prints")
    groups = durable(prints.groupBy(*FP).agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    known = F.coalesce("doc_id", F.lit(-1)).alias("id")
    members = durable(prints.join(groups, FP).select(known, "row_key", *FP, "size"), "members")
    # the same join at every size: texts are dealt by key once
    candidates = durable(members.hint("merge").join(keyed(docs).select(known, "row_key", "norm"), ["id", "row_key"]), "candidates")
    unequal = unequal_groups(candidates).withColumn("torn", F.lit(True))
    # texts that differ under an equal fingerprint are told apart by their whole digest
    classed = prints.join(unequal, FP, "left").withColumn("variant", F.when(F.col("torn"), F.col("text_sha256")).otherwise("")).drop("torn")
    cls = [*FP, "variant"]
    sizes = durable(classed.groupBy(*cls).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "sizes")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return classed.join(sizes, cls).select(
        "doc_id", "row_key", "keep_id", "group_size", stays.alias("stays"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).select("doc_id", "row_key", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (norm)
"""
