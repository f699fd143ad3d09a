"""Packing of token pieces into sequences by bounded-space online best-fit (operator 7).

A task keeps a fixed number of open bins in a bitset keyed by free space, puts each piece into the fullest bin
that takes it, and closes the fullest bin when the number is reached. What is still open at the end of a task goes
on to a next round, as one item per bin, in fewer tasks, until one small task closes the rest. No task sees more
than its share, and only the open bins move between rounds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import units
from ledgerloom.llm.common import slices, table
from ledgerloom.session import durable

SIZE = 1024
OPEN = 512
END = 2


def cut(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of each document's ids (with ``end`` behind): doc_id, piece, start, length, ids_crc32, ids.

    Only documents longer than ``size`` are cut; the first piece takes the rest, so the others are full. A null
    text is empty and gives the end id alone. Rows with null or repeated ids give pieces like all others.
    """

    def run(batches):
        u = units(tokenizer)
        for ids, texts in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(texts):
                got = np.append(u.text_ids(t or ""), np.uint32(end)).astype("<u4")
                first = len(got) % size or size
                for n, at in enumerate([0, *range(first, len(got), size)]):
                    part = got[at : first if not n else at + size]
                    row.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins by free space: ``bins[f]`` lists those with ``f`` left, bit ``f`` of ``free`` tells it is not empty."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.open = size, most, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def take(self, f: int) -> int:
        b = self.bins[f].pop()
        if not self.bins[f]:
            self.free ^= 1 << f
        self.open -= 1
        return b

    def put(self, b: int, f: int) -> None:
        if f:
            self.bins[f].append(b)
            self.free |= 1 << f
            self.open += 1

    def add(self, need: int, fresh: int) -> tuple[int, int, int | None]:
        """Bin for an item of ``need`` (``fresh`` if none fits), its offset there, and the bin closed for space."""
        above = self.free >> need
        closed = None
        if above:
            f = need + (above & -above).bit_length() - 1
            b = self.take(f)
        else:
            b, f = fresh, self.size
            if self.open >= self.most:
                closed = self.take((self.free & -self.free).bit_length() - 1)
        self.put(b, f - need)
        return b, self.size - f, closed

    def left(self) -> dict[int, int]:
        return {b: f for f, bins in enumerate(self.bins) for b in bins}


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def place(pieces: DataFrame, size: int, most: int, last: bool) -> DataFrame:
    """Give each row its bin (unique over tasks) and its offset there. Unless ``last``, a row with a null length
    follows for each bin still open at the end of the task, with its used space as the offset."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        heap, n = BestFit(size, most), 0
        for b in batches:
            need = b.column(3).to_pylist()
            bins, offsets = [], []
            for x in need:
                at, offset, _ = heap.add(x, n)
                n += at == n
                bins.append(at + base)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=NAMES)
        left = {} if last else heap.left()
        if left:
            none = [pa.nulls(len(left), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array([b + base for b in left], pa.int64()), pa.array([size - f for f in left.values()], pa.int64())], names=NAMES
            )

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(run, PLACED)


NAMES = [c.split()[0] for c in PLACED.split(", ")]


def pack(pieces: DataFrame, size: int = SIZE, most: int = OPEN, share: int = 100_000) -> DataFrame:
    """pieces (doc_id, piece, start, length up to ``size``, ids_crc32) with sequence_id and offset.

    Every task of every round has ``most`` open bins. ``share`` is the number of items a task of a later round takes on. Lengths under 1 are an error.
    """
    placed = durable(place(pieces, size, most, False), "packed")
    out = placed.filter("length IS NOT NULL")
    left = placed.filter("length IS NULL")
    # a task leaves ``most`` bins open at most, so every round has half as many bins at least
    n, k, share = left.count(), 0, max(share, 2 * most)
    moves = None
    while n:
        k += 1
        tasks = -(-n // share)
        # an open bin is an item: its bin in the place of the document, its used space as the length
        items = left.select(F.col("bin").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("offset").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
        dealt = items.repartition(tasks, F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"), "doc_id")
        done = durable(place(dealt, size, most, tasks == 1), "packed")
        step = done.filter("length IS NOT NULL").select(F.col("doc_id").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        if moves is None:
            moves = step.withColumn("round", F.lit(k))
        else:
            # follow a bin on into the bin of the next round
            after = step.toDF("to", "to2", "shift2").withColumn("round", F.lit(k - 1))  # bins are numbered anew in each round
            moves = durable(
                moves.join(after, ["to", "round"], "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"), F.when(F.col("to2").isNotNull(), k).otherwise(F.col("round")).alias("round")),
                "moves",
            )
        left = done.filter("length IS NULL")
        n = 0 if tasks == 1 else left.count()
    if moves is not None:
        joined = out.join(moves, "bin", "left")
        return joined.select(
            *NAMES[:5], (F.coalesce("to", "bin") * 8 + F.coalesce("round", F.lit(0))).alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    return out.select(*NAMES[:5], (F.col("bin") * 8).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(durable(cut(docs, tokenizer), "pieces"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
