"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, html_text, language_id, lexical, lm_scoring, mixing, near_dedup, phrases, pii, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_pii_spans": pii.query,
    "op2_quality_rules": quality.query,
    "op3_cross_polytope": ann.query,
    "op4_source_mixing": mixing.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_toxicity": toxicity.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_html_extraction": html_text.query,
    "op9_near_dedup": near_dedup.query,
    "op10_bpe_trie": bpe.query,
    "op11_lexical_search": lexical.query,
    "op12_language_id": language_id.query,
    "op13_phrase_mining": phrases.query,
}
ORACLES: dict[str, str] = {"op4_source_mixing": mixing.SQL, "op11_lexical_search": lexical.SQL, "op13_phrase_mining": phrases.SQL}
