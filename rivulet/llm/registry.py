"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .bpe import op6_bpe
from .conversation_repair import op11_conversation_repair
from .decontaminate import ORACLE as DECONTAMINATE_SQL
from .decontaminate import op4_decontaminate
from .language_id import op7_language_id
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import PASSAGE_ORACLE as PASSAGE_DEDUP_SQL
from .line_dedup import op1_line_dedup, op1_passage_dedup
from .near_dedup import ORACLE as NEAR_DEDUP_SQL
from .near_dedup import op2_near_dedup
from .packing import op12_packing
from .prefix_trie import op13_prefix_trie
from .quality_fm import op5_quality_fm
from .quality_rules import op8_quality_rules
from .suffix_dedup import ORACLE as SUFFIX_DEDUP_SQL
from .suffix_dedup import op9_suffix_dedup
from .token_files import op10_token_files
from .toxicity import op3_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_fm": op5_quality_fm,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_packing": op12_packing,
    "op13_prefix_trie": op13_prefix_trie,
    "op1_passage_dedup": op1_passage_dedup,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op1_passage_dedup": PASSAGE_DEDUP_SQL,
    "op2_near_dedup": NEAR_DEDUP_SQL,
    "op4_decontaminate": DECONTAMINATE_SQL,
    "op9_suffix_dedup": SUFFIX_DEDUP_SQL,
}
