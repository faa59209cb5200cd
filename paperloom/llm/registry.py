"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op2_sharding, op10_warc
from .op1_additive_ann import op1_additive_ann
from .op3_contextual_pii import op3_contextual_pii
from .op4_token_matrices import op4_token_matrices
from .op5_ngram_join import op5_ngram_join
from .op6_html_extraction import op6_html_extraction
from .op7_decontamination import op7_decontamination
from .op8_packing import op8_packing
from .op9_language_id import op9_language_id


def queries() -> dict:
    return {
        "op1_additive_ann": op1_additive_ann,
        "op2_sharding": op2_sharding.op2_sharding,
        "op3_contextual_pii": op3_contextual_pii,
        "op4_token_matrices": op4_token_matrices,
        "op5_ngram_join": op5_ngram_join,
        "op6_html_extraction": op6_html_extraction,
        "op7_decontamination": op7_decontamination,
        "op8_packing": op8_packing,
        "op9_language_id": op9_language_id,
        "op10_warc": op10_warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": op2_sharding.oracle(), "op10_warc": op10_warc.ORACLE}
