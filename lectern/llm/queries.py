"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm.decontamination import OP7_SQL, op7_decontamination
from lectern.llm.filter_audit import OP13_SQL, op13_filter_audit
from lectern.llm.fingerprints import op11_fingerprints
from lectern.llm.html_extraction import op1_html_extraction
from lectern.llm.lm_scoring import op6_lm_scoring
from lectern.llm.mixing import OP10_SQL, op10_mixing
from lectern.llm.near_dedup import op3_near_dedup
from lectern.llm.pii import op4_pii
from lectern.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from lectern.llm.quality_classifier import op9_quality_classifier
from lectern.llm.quality_rules import OP2_SQL, op2_quality_rules
from lectern.llm.secret_scans import OP8_SQL, op8_secret_scans
from lectern.llm.url_filters import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_pii": op4_pii,
    "op5_url_filters": op5_url_filters,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing": op10_mixing,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {k: v for k, v in {
    "op2_quality_rules": OP2_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_secret_scans": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}.items() if v}
