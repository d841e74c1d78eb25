"""The contract queries and their SQL, by name."""

from __future__ import annotations

from edgeframe.llm import html_main, latent, licenses, near_dups, pieces, quality, secrets, sharding, substring, token_counts

QUERIES = {
    "op1_substring_dedup": substring.op1,
    "op2_token_counts": token_counts.op2,
    "op3_secret_scans": secrets.op3,
    "op4_sharding": sharding.op4,
    "op5_quality_rules": quality.op5,
    "op6_license_scans": licenses.op6,
    "op7_html_extraction": html_main.op7,
    "op8_minhash_near_dedup": near_dups.op8,
    "op9_benchmark_decontamination": latent.op9,
    "op10_sentencepiece": pieces.op10,
}
ORACLE_SQL = {"op1_substring_dedup": substring.OP1_SQL, "op3_secret_scans": secrets.OP3_SQL, "op4_sharding": sharding.OP4_SQL, "op6_license_scans": licenses.OP6_SQL, "op8_minhash_near_dedup": near_dups.OP8_SQL}
