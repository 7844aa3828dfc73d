"""The queries of this folder and, where SQL can express them, their oracles."""

from strandline.llm import attention_lm, bpe_prefix, line_winnow, mil_quality, perspectives, risk_rules, secret_forest, seed_decontam, simhash_ring, warc_segments

MODULES = (mil_quality, line_winnow, simhash_ring, secret_forest, attention_lm, perspectives, seed_decontam, warc_segments, bpe_prefix, risk_rules)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
