"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import gif, huffman, langid, licenses, mixing, packing, quality, sharding, simhash, urltree

QUERIES = {
    "op1_huffman": huffman.op1_huffman,
    "op2_gif": gif.op2_gif,
    "op3_extendible_hashing": sharding.op3_extendible_hashing,
    "op4_order_preserving": packing.op4_order_preserving,
    "op5_viterbi": langid.op5_viterbi,
    "op6_diagonal_voting": licenses.op6_diagonal_voting,
    "op7_golden_ratio": mixing.op7_golden_ratio,
    "op8_line_first": quality.op8_line_first,
    "op9_covering_lsh": simhash.op9_covering_lsh,
    "op10_path_templates": urltree.op10_path_templates,
}

ORACLE_SQL = {
    "op3_extendible_hashing": sharding.ORACLE_SQL,
    "op6_diagonal_voting": licenses.ORACLE_SQL,
    "op7_golden_ratio": mixing.ORACLE_SQL,
    "op8_line_first": quality.ORACLE_SQL,
    "op10_path_templates": urltree.ORACLE_SQL,
}
