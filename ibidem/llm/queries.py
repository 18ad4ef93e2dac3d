"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import crossalign, decontaminate, eliasfano, extract, infill, mixing, packing, quality, simhash, suffixtree, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_quality_mcd": quality.op1,
        "op2_elias_fano_ids": eliasfano.op2,
        "op3_url_rules": urlfilter.op3,
        "op4_spaced_seed_decontamination": decontaminate.op4,
        "op5_crf_toxicity": toxicity.op5,
        "op6_warc_normaliser": warc.op6,
        "op7_best_fit_packing": packing.op7,
        "op8_text_density": extract.op8,
        "op9_suffix_tree_lm": suffixtree.op9,
        "op10_simhash_near_dedup": simhash.op10,
        "op11_source_mixing": mixing.op11,
        "op12_cross_tokenizer_alignment": crossalign.op12,
        "op13_fill_in_middle": infill.op13,
    }


def oracle_sql() -> dict:
    return {"op3_url_rules": urlfilter.OP3_SQL, "op6_warc_normaliser": warc.OP6_SQL, "op11_source_mixing": mixing.OP11_SQL, "op13_fill_in_middle": infill.OP13_SQL}
