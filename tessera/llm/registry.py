"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, exact, jaccard, lm, mixing, neardup, quality, repair, secrets, substring, topk, whitening

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op1_substring_batches": substring.op1_substring_batches,
    "op2_chat": chat.op2_chat,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_quality": quality.op4_quality,
    "op5_neardup": neardup.op5_neardup,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm": lm.op7_lm,
    "op8_secrets": secrets.op8_secrets,
    "op9_topk": topk.op9_topk,
    "op10_bpe": bpe.op10_bpe,
    "op11_exact": exact.op11_exact,
    "op12_whitening": whitening.op12_whitening,
    "op13_repair": repair.op13_repair,
}

SQL = {
    "op1_substring": substring.OP1_SQL,
    "op1_substring_batches": substring.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op3_jaccard": jaccard.OP3_SQL,
    "op5_neardup": neardup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_lm": lm.OP7_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_exact": exact.OP11_SQL,
    "op13_repair": repair.OP13_SQL,
}
