"""The registered queries of this subpackage and their SQL."""

from winnowry.llm import audit, codes, decontaminate, language, licenses, linededup, lm, minhash, mixing, quality, secrets, suffix, topk

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_suffix": suffix.op2_suffix,
    "op3_topk": topk.op3_topk,
    "op4_secrets": secrets.op4_secrets,
    "op5_licenses": licenses.op5_licenses,
    "op6_quality": quality.op6_quality,
    "op7_lm": lm.op7_lm,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_minhash": minhash.op10_minhash,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_language": language.op13_language,
}
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_topk": topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op12_vector_codes": codes.ORACLE,
}
