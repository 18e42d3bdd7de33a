"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontamination import OP8_SQL, op8_decontaminate
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import OP3_SQL, op3_html_extract
from .language_id import op1_language_id
from .language_model import op12_lm_scoring
from .licenses import BASE_SQL as LICENSE_BASE_SQL, base_license_scan, op7_license_scan
from .near_duplicates import OP6_SQL, op6_jaccard_join
from .packing import op2_best_fit_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import BASE_SQL as RULES_BASE_SQL, base_quality_rules, op10_quality_rules
from .resampling import OP13_SQL, op13_importance_resampling
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_html_extract, op4_quality_classifier, op5_chat_format, op6_jaccard_join, op7_license_scan, op8_decontaminate, op9_toxicity, op10_quality_rules, op11_filter_audit, op12_lm_scoring, op13_importance_resampling, base_license_scan, base_quality_rules)}

#: The others have no SQL: tests hold them against brute force or held-out labels.
ORACLES: dict[str, str] = {"op3_html_extract": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op8_decontaminate": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_importance_resampling": OP13_SQL, "base_license_scan": LICENSE_BASE_SQL, "base_quality_rules": RULES_BASE_SQL}
