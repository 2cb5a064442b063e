"""The operators' queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import ann, conversations, decontam, katz, language_id, line_dedup, packing, periodic_runs, simhash, substring_dedup, token_store, toxicity, warc


def queries() -> dict:
    return {
        "op1_ann": ann.op1_ann,
        "op2_simhash": simhash.op2_simhash,
        "op3_token_store": token_store.op3_token_store,
        "op4_lines": line_dedup.op4_lines,
        "op5_decontam": decontam.op5_decontam,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_katz": katz.op8_katz,
        "op9_packing": packing.op9_packing,
        "op10_substring": substring_dedup.op10_substring,
        "op11_language": language_id.op11_language,
        "op12_repair": conversations.op12_repair,
        "op13_runs": periodic_runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_lines": line_dedup.OP4_SQL,
        "op5_decontam": decontam.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op10_substring": substring_dedup.OP10_SQL,
        "op11_language": language_id.OP11_SQL,
        "op12_repair": conversations.OP12_SQL,
    }
