"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import ann, ball_kmeans, exact_dedup, fill_in_middle, html_extract, packing, pii, secret_scan, sentencepiece_viterbi, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.QUERY,
    "op2_warc": warc.QUERY,
    "op3_html_extract": html_extract.QUERY,
    "op4_sentencepiece": sentencepiece_viterbi.QUERY,
    "op5_nearest": ann.QUERY,
    "op6_packing": packing.QUERY,
    "op7_substring_dedup": substring_dedup.QUERY,
    "op8_exact_dedup": exact_dedup.QUERY,
    "op9_pii": pii.QUERY,
    "op10_simhash": simhash.QUERY,
    "op11_fill_in_middle": fill_in_middle.QUERY,
    "op12_secret_scan": secret_scan.QUERY,
    "op13_ball_kmeans": ball_kmeans.QUERY,
}
ORACLES = {"op2_warc": warc.SQL, "op8_exact_dedup": exact_dedup.SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
