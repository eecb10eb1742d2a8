"""The package's queries, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from sightline.llm import (
    collocations,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    wrapper,
)


def queries() -> dict:
    return {
        "op1_html_text": wrapper.op1_html_text,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_language_id": language_id.op3_language_id,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_token_files": token_files.op5_token_files,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_mixing": mixing.op8_mixing,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact_dedup.SQL,
        "op7_decontaminate": decontaminate.SQL,
        "op13_collocations": collocations.SQL,
    }
