"""The operators' queries by name, and DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from episodia.llm import collocations, html_extract, language_id, license_scan, merkle_manifest, ngram_join, quality_rules, segment_sampling, source_mix, suffix_dedup, topk_search, url_filter, warc

QUERIES = {
    "op1_topk_search": topk_search.query,
    "op2_warc_index": warc.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_source_mix": source_mix.query,
    "op5_license_scan": license_scan.query,
    "op6_url_filter": url_filter.query,
    "op7_html_extract": html_extract.query,
    "op8_ngram_join": ngram_join.query,
    "op9_quality_rules": quality_rules.query,
    "op10_segment_sampling": segment_sampling.query,
    "op11_collocations": collocations.query,
    "op12_language_id": language_id.query,
    "op13_merkle_manifest": merkle_manifest.query,
}
ORACLES: dict[str, str] = {
    "op1_topk_search": topk_search.ORACLE,
    "op2_warc_index": warc.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
