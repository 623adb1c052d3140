"""The corpus queries that ``__spark_entry__`` adds, and SQL where SQL can express them."""

from . import decontaminate, quality_rules, sentencepiece_agenda, sharding, simhash, surrogates, token_store, topk, url_filter, warc_audit

QUERIES = {
    "op1_sentencepiece": sentencepiece_agenda.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_topk": topk.op3_topk,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_quality": quality_rules.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_token_store": token_store.op8_token_store,
    "op9_warc_audit": warc_audit.op9_warc_audit,
    "op10_url_filters": url_filter.op10_url_filters,
}
ORACLES = {
    "op3_topk": topk.ORACLE,
    "op9_warc_audit": warc_audit.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
}
