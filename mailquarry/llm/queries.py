"""The registered queries of this subpackage and the SQL that can check them."""

from __future__ import annotations

from mailquarry.llm.chat_rotation import OP1_SQL, op1_rotation
from mailquarry.llm.dac_tokens import op2_dac
from mailquarry.llm.decontamination import OP5_SQL, op5_containment
from mailquarry.llm.embedding_dedup import op6_int8
from mailquarry.llm.minhash_dedup import op9_minhash
from mailquarry.llm.ppm_language import op10_ppm
from mailquarry.llm.quality_mil import op7_attention
from mailquarry.llm.sentencepiece_tokens import op3_sentencepiece
from mailquarry.llm.suffix_dedup import op4_suffix
from mailquarry.llm.toxic_segments import op8_segments

QUERIES = {
    "op1_rotation": op1_rotation,
    "op2_dac": op2_dac,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix": op4_suffix,
    "op5_containment": op5_containment,
    "op6_int8": op6_int8,
    "op7_attention": op7_attention,
    "op8_segments": op8_segments,
    "op9_minhash": op9_minhash,
    "op10_ppm": op10_ppm,
}

ORACLE_SQL: dict[str, str] = {"op1_rotation": OP1_SQL, "op5_containment": OP5_SQL}
