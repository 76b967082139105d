"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from netsieve.llm.ann import op9_hilbert_ann
from netsieve.llm.centroids import op13_centroid_clusters
from netsieve.llm.extraction import op8_html_text
from netsieve.llm.mixing import OP10_SQL, op10_mix_sources
from netsieve.llm.near_dedup import op1_minhash_near_dedup
from netsieve.llm.packing import op5_best_fit_packing
from netsieve.llm.periodic import op12_periodic_runs
from netsieve.llm.pieces import op11_sentencepiece
from netsieve.llm.quality import op4_quality
from netsieve.llm.token_store import op7_token_store
from netsieve.llm.toxicity import op6_toxicity
from netsieve.llm.url_filter import OP3_SQL, op3_url_filter
from netsieve.llm.vector_dedup import op2_vector_dedup

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_store": op7_token_store,
    "op8_html_text": op8_html_text,
    "op9_hilbert_ann": op9_hilbert_ann,
    "op10_mix_sources": op10_mix_sources,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES = {
    "op3_url_filter": OP3_SQL.strip(),
    "op10_mix_sources": OP10_SQL.strip(),
}
