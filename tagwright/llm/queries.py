"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from . import decontaminate, language_id, minhash_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_files, url_filters

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_url_filters": url_filters.query,
    "op3_quality_rules": quality_rules.query,
    "op4_language_id": language_id.query,
    "op5_secret_scan": secret_scan.query,
    "op6_token_files": token_files.query,
    "op7_packing": packing.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_decontaminate": decontaminate.query,
    "quality_rule_ablations": quality_rules.ablation_query,
}
ORACLE_SQL = {
    "op2_url_filters": url_filters.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "quality_rule_ablations": quality_rules.ABLATION_SQL,
}
