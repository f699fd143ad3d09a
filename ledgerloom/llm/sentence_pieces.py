"""SentencePiece encoding and decoding of whole texts (operator 11), by the merge rounds of :mod:`ledgerloom.llm.piece_bpe`.

No shuffle: each task encodes its own rows, a bounded number at a time, and keeps the words it has met. A lost task
starts again from its input. All functions read doc_id and text (or ids) only, so other columns may have any name. A
null text counts as empty and has the begin and end ids alone; null and repeated doc_ids keep their rows; an empty
table gives no rows. A text is never cut, however long; the words of one batch are settled a million characters at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, table
from ledgerloom.llm.piece_bpe import pieces

#: Characters of text that one step takes on, unless a single text has more.
STEP = 4_000_000


def steps(batches):
    """(ids, texts) of Arrow batches in steps of bounded size."""
    for ids, texts in slices(batches):
        start = size = 0
        for k, t in enumerate(texts):
            n = len(t or "")
            if k > start and size + n > STEP:
                yield ids.slice(start, k - start), texts[start:k]
                start, size = k, 0
            size += n
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end
    ids included), decoded (the text that the ids give)."""

    def run(batches):
        p = pieces(model)
        for ids, texts in steps(batches):
            flat, sizes = p.encode([t or "" for t in texts])
            data, ends = flat.astype("<u4").tobytes(), np.append(0, np.cumsum(sizes)).tolist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array([data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
                 pa.array([t.decode() for t in p.decode(flat, sizes)], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids array<int>) to doc_id, text. Null ids count as none and give an empty text; ids outside of the
    vocabulary are an error."""

    def run(batches):
        p = pieces(model)
        for doc_ids, lists in slices(batches):
            sizes = np.array([len(i or []) for i in lists], np.int64)
            flat = np.array([x for i in lists for x in i or []], np.int64)
            if len(flat) and not 0 <= flat.min() <= flat.max() < p.size:
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([t.decode() for t in p.decode(flat, sizes)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
