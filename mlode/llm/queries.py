"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from mlode.llm import chat, decontam, jaccard, langid, mixing, quality, site_tree, substring, token_files, warc


def queries() -> dict:
    return {
        "op1_warc_archive": warc.op1_warc_archive,
        "op2_ppm_language": langid.op2_ppm_language,
        "op3_site_style_tree": site_tree.op3_site_style_tree,
        "op4_perspective_rotation": chat.op4_perspective_rotation,
        "op5_fixed_block_anchors": substring.op5_fixed_block_anchors,
        "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_token_frames": token_files.op8_token_frames,
        "op9_poisson_mixing": mixing.op9_poisson_mixing,
        "op10_minhash_decontamination": decontam.op10_minhash_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_archive": warc.SQL,
        "op4_perspective_rotation": chat.SQL,
        "op5_fixed_block_anchors": substring.SQL,
        "op6_ngram_jaccard": jaccard.SQL,
        "op9_poisson_mixing": mixing.SQL,
        "op10_minhash_decontamination": decontam.SQL,
    }
