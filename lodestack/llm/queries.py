"""The registered queries of this folder, and their SQL where SQL can say the same."""

from . import langid, linededup, media, mixing, packing, pii, prefixtrie, quality, secrets, simhash, tokenfile, toxicity, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_media_columns": media.op2_media_columns,
    "op3_language_id": langid.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_token_output": tokenfile.op5_token_output,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_secrets": secrets.op11_secrets,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op12_prefix_trie": prefixtrie.OP12_SQL,
}
