"""The queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from lumenark.llm import chosenpath, crosstok, decontam, langid, linededup, packing, pivots, prefixtrie, quality, secrets, surrogates, tokenfile, wordpiece

QUERIES = {
    "op1_permutation_index": pivots.op1,
    "op2_prefix_decontamination": decontam.op2,
    "op3_weak_label_quality": quality.op3,
    "op4_token_file": tokenfile.op4,
    "op5_pii_surrogates": surrogates.op5,
    "op6_word_piece_counts": wordpiece.op6,
    "op7_secret_ownership": secrets.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_chosen_path_join": chosenpath.op9,
    "op10_byte_network": langid.op10,
    "op11_conversation_trie": prefixtrie.op11,
    "op12_cross_tokenizer": crosstok.op12,
    "op13_line_dedup": linededup.op13,
}

ORACLES = {
    "op2_prefix_decontamination": decontam.OP2_SQL,
    "op11_conversation_trie": prefixtrie.OP11_SQL,
    "op13_line_dedup": linededup.OP13_SQL,
}
