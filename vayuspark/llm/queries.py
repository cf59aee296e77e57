"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

from vayuspark.llm.align import op11_token_alignment
from vayuspark.llm.bpe import op5_byte_bpe
from vayuspark.llm.chat import OP9_SQL, op9_perspectives
from vayuspark.llm.decontaminate import OP10_SQL, op10_decontaminate
from vayuspark.llm.embeddings import OP7_SQL, op7_embedding_neardup
from vayuspark.llm.licenses import OP3_SQL, op3_license_scan
from vayuspark.llm.minhash import OP1_SQL, op1_minhash_neardup
from vayuspark.llm.packing import op13_best_fit_packing
from vayuspark.llm.phrases import OP12_SQL, op12_collocations
from vayuspark.llm.quality import op2_quality
from vayuspark.llm.shard import op6_virtual_slots
from vayuspark.llm.substring import OP4_SQL, op4_substring_dedup
from vayuspark.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_toxicity": op8_toxicity,
    "op9_perspectives": op9_perspectives,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLES = {
    "op1_minhash_neardup": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_embedding_neardup": OP7_SQL,
    "op9_perspectives": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_collocations": OP12_SQL,
}
