"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .audit import op11_filter_audit
from .decontam import op9_decontamination
from .html_text import op7_html
from .langid import op4_langid
from .licenses import op2_licenses
from .line_dedup import op13_line_dedup
from .lm_score import op10_lm_scores
from .minhash import op1_minhash
from .negatives import op12_hard_negatives
from .oracles import ORACLES
from .packing import op6_packing
from .quality import op8_quality
from .sharding import op3_sharding
from .token_files import op5_token_files

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_minhash": op1_minhash,
    "op10_lm_scores": op10_lm_scores,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
    "op2_licenses": op2_licenses,
    "op3_sharding": op3_sharding,
    "op4_langid": op4_langid,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
}
