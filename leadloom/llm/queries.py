"""The queries of this subpackage by name, and the SQL that they are held against."""

from leadloom.llm import chat, decontamination, exact_dedup, language, licenses, merkle, near_dedup, packing, pitman_yor, quality, spelling, token_counts, token_files

QUERIES = {
    "op10_lm_scores": pitman_yor.op10_lm_scores,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_language_id": language.op12_language_id,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_chat": chat.op7_chat,
    "op8_token_files": token_files.op8_token_files,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op11_spelling_variants": spelling.ORACLE,
    "op12_language_id": language.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
