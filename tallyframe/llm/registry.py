"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyframe.llm.chat_format import OP10_SQL, op10_chat_format
from tallyframe.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tallyframe.llm.histogram_sort import op3_histogram_sort
from tallyframe.llm.itq_neighbours import op11_itq_neighbours
from tallyframe.llm.language_id import op1_language_id
from tallyframe.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from tallyframe.llm.packing import op8_best_fit_packing
from tallyframe.llm.partenum_join import op7_partenum_join
from tallyframe.llm.pfair_mix import OP4_SQL, op4_pfair_mix
from tallyframe.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tallyframe.llm.quality_crf import op5_quality_crf
from tallyframe.llm.token_files import op9_zstd_token_files
from tallyframe.llm.token_rollups import op2_token_rollups

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_rollups": op2_token_rollups,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_quality_crf": op5_quality_crf,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_partenum_join": op7_partenum_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_zstd_token_files": op9_zstd_token_files,
    "op10_chat_format": op10_chat_format,
    "op11_itq_neighbours": op11_itq_neighbours,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op4_pfair_mix": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
