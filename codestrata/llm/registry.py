"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, jaccard, licenses, mixing, pii, sharding, toxicity, transport, vptree, wrappers

QUERIES = {
    "op1_byte_level_bpe": bpe.op1_byte_level_bpe,
    "op2_vantage_point_neighbors": vptree.op2_vantage_point_neighbors,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_html_wrappers": wrappers.op4_html_wrappers,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii_sanitisation": pii.op6_pii_sanitisation,
    "op7_transport_streams": transport.op7_transport_streams,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_hash_tree_sharding": sharding.op9_hash_tree_sharding,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLES = {
    "op3_source_mixing": mixing.SQL,
    "op8_ngram_jaccard_join": jaccard.SQL,
    "op9_hash_tree_sharding": sharding.SQL,
}
