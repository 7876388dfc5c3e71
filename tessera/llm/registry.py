"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tessera.llm import exact_dedup, licenses, line_quality, mixing, ngram_join, packing, secrets, token_counts, url_filter, warc

QUERIES = {
    "op1_line_quality": line_quality.op1_line_quality,
    "op2_pack_best_fit": packing.op2_pack_best_fit,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_license_scan": licenses.op8_license_scan,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_mix_pivotal": mixing.op10_mix_pivotal,
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_ngram_jaccard": ngram_join.SQL,
    "op6_warc_round_trip": warc.SQL,
    "op9_url_filter": url_filter.SQL,
}
