"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, fingerprints, hmm, html_text, lexical, line_dedup, maxscore, mixing, packing, quality, simhash, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_maxscore": maxscore.op2_maxscore,
    "op3_hmm": hmm.op3_hmm,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_html_text": html_text.op6_html_text,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversations": conversations.op11_conversations,
    "op12_lexical": lexical.op12_lexical,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

ORACLE_SQL = {"op1_mix_sources": mixing.OP1_SQL, "op2_maxscore": maxscore.OP2_SQL, "op4_quality": quality.OP4_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op8_warc": warc.OP8_SQL, "op11_conversations": conversations.OP11_SQL, "op12_lexical": lexical.OP12_SQL, "op13_fingerprints": fingerprints.OP13_SQL}
