"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from vecprune.llm.align import op13_align
from vecprune.llm.anchors import op4_anchors
from vecprune.llm.bpe import op8_byte_bpe
from vecprune.llm.decontaminate import op7_decontaminate
from vecprune.llm.langid import op5_language
from vecprune.llm.lm import op9_attention_scores
from vecprune.llm.pii import op6_pii
from vecprune.llm.quotes import OP10_SQL, op10_quotes
from vecprune.llm.repetition import OP1_SQL, op1_repetition
from vecprune.llm.simhash import op2_simhash
from vecprune.llm.suffix import op3_suffix
from vecprune.llm.trie import OP11_SQL, op11_trie
from vecprune.llm.warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_simhash": op2_simhash,
    "op3_suffix": op3_suffix,
    "op4_anchors": op4_anchors,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_attention_scores": op9_attention_scores,
    "op10_quotes": op10_quotes,
    "op11_trie": op11_trie,
    "op12_warc": op12_warc,
    "op13_align": op13_align,
}

ORACLE = {
    "op1_repetition": OP1_SQL,
    "op10_quotes": OP10_SQL,
    "op11_trie": OP11_SQL,
    "op12_warc": OP12_SQL,
}
