"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from loomline.llm import curves, decontaminate, hostrep, langid, lexical, lloyd, lmscore, outliers, packing, privacy, rollup, sharding, simhash

QUERIES = {
    "op1_pseudo_likelihood": lmscore.query,
    "op2_token_rollup": rollup.query,
    "op3_robust_outliers": outliers.query,
    "op4_vector_packing": packing.query,
    "op5_disclosure_terms": privacy.query,
    "op6_lpt_shards": sharding.query,
    "op7_host_reputation": hostrep.query,
    "op8_popcount_simhash": simhash.query,
    "op9_ppm_language": langid.query,
    "op10_template_leaks": decontaminate.query,
    "op11_impact_search": lexical.query,
    "op12_hilbert_neighbours": curves.query,
    "op13_delta_lloyd": lloyd.query,
}
ORACLES = {"op2_token_rollup": rollup.SQL, "op7_host_reputation": hostrep.SQL, "op11_impact_search": lexical.SQL, "op13_delta_lloyd": lloyd.SQL}
