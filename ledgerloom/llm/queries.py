"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from ledgerloom.llm import chat_format, decontaminate, exact_dedup, lm_scoring, merkle, ngram_join, packing, resampling, sentence_pieces, token_counts, toxicity, url_filters, warc

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate,
        warc.op2_warc,
        toxicity.op3_toxicity,
        chat_format.op4_chat_format,
        exact_dedup.op5_exact_dedup,
        url_filters.op6_url_filters,
        packing.op7_best_fit_packing,
        token_counts.op8_token_counts,
        lm_scoring.op9_lm_scoring,
        ngram_join.op10_ngram_join,
        sentence_pieces.op11_sentencepiece,
        merkle.op12_merkle,
        resampling.op13_resampling,
    )
}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_warc": warc.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
