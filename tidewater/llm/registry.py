"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, decontaminate, divergence, fertility, html, lines, minhash, mixing, quality, resample, sentences, suffix, warc

QUERIES = {
    "op1_suffix_array": suffix.op1_suffix_array,
    "op2_warc_zstd": warc.op2_warc_zstd,
    "op3_tree_scoring": html.op3_tree_scoring,
    "op4_quality": quality.op4_quality,
    "op5_sentence_spans": sentences.op5_sentence_spans,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_robust_graph": ann.op7_robust_graph,
    "op8_pigeonhole": decontaminate.op8_pigeonhole,
    "op9_line_frequency": lines.op9_line_frequency,
    "op10_hyperminhash": minhash.op10_hyperminhash,
    "op11_word_tries": resample.op11_word_tries,
    "op12_token_fertility": fertility.op12_token_fertility,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op2_warc_zstd": warc.OP2_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op9_line_frequency": lines.OP9_SQL,
    "op10_hyperminhash": minhash.OP10_SQL,
    "op11_word_tries": resample.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
