"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from framewright.llm import decontaminate, jaccard, langid, linededup, mixing, secrets, suffixdedup, tokencounts, topk, toxicity

QUERIES = {
    "op1_token_rollup": tokencounts.op1_token_rollup,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_topk_search": topk.op9_topk_search,
    "op10_toxicity": toxicity.op10_toxicity,
}
#: Equivalent SQL, where SQL can say it over whole tables in fair time.
ORACLES = {
    "op2_line_dedup": linededup.LINES_SQL.format(docs="documents"),
    "op3_secret_scan": secrets.secrets_sql("documents"),
    "op4_mix_sources": mixing.MIX_SQL.format(docs="documents"),
    "op7_jaccard_join": jaccard.JACCARD_SQL.format(docs="documents"),
    "op8_decontaminate": decontaminate.DECON_SQL.format(docs="documents"),
    "op9_topk_search": topk.TOPK_SQL,
}
