"""Exact token counts of texts and of their prefixes (operator 8).

The dynamic program of :mod:`ledgerloom.llm.bpe` counts each new unit (and any of its prefixes) from the tokens that
may follow each other; a text keeps the exact token count at the end of every unit. Counts, budget checks and truncation points are then looked up; no
text is encoded again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import UnitCounts, units
from ledgerloom.llm.common import slices, table

LIMIT = 1024


def prefix_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, prefix_chars and prefix_tokens (characters and
    tokens up to the end of each unit), fit_chars (characters of the longest prefix of at most ``limit`` tokens).

    A null text counts as empty: no units, 0 bytes. Null and repeated ids keep their rows. Other columns are not read.
    """

    def run(batches):
        u = units(tokenizer, UnitCounts)
        for ids, texts in slices(batches):
            size, chars, tokens, fit = [], [], [], []
            for t in texts:
                t = t or ""
                c, n = u.prefix(t)
                size.append(len(t.encode()))
                chars.append(c.astype(np.int32))
                tokens.append(n.astype(np.int32))
                fit.append(len(t) if not len(n) or n[-1] <= limit else u.truncate(t, limit))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), lists(chars), lists(tokens), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "prefix_chars", "prefix_tokens", "fit_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, prefix_chars array<int>, prefix_tokens array<int>, fit_chars long"
    )


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n = F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"), "fit_chars")
