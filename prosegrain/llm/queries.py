"""The registered queries of this subpackage, and SQL for those that SQL can express."""

import corpus_pipeline
from prosegrain.llm import bpe, curves, divergence, infill, jaccard, langid, packing, pii, quality, secrets, suffixes, topk, urls

_OPERATORS = (
    quality.op1_quality_network, urls.op2_url_filters, jaccard.op3_ngram_jaccard, curves.op4_shifted_hilbert, pii.op5_pii_bootstrap,
    topk.op6_columnar_topk, packing.op7_cost_packing, suffixes.op8_suffix_dedup, langid.op9_byte_gru, bpe.op10_bpe_automaton,
    divergence.op11_source_divergence, secrets.op12_secret_ledger, infill.op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLES = {
    "op2_url_filters": urls.OP2_SQL, "op3_ngram_jaccard": jaccard.OP3_SQL, "op6_columnar_topk": topk.OP6_SQL,
    "op11_source_divergence": divergence.OP11_SQL, "op12_secret_ledger": secrets.OP12_SQL, "op13_fill_in_middle": infill.OP13_SQL,
}
