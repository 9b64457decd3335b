"""Queries of the text operators, by name, and their SQL."""

from __future__ import annotations

from . import embedding, html_text, packing, pieces, pii, quality, secrets, simhash, sketch, substring


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_sentence_spans": substring.query,
        "op2_simhash": simhash.query,
        "op3_attention_quality": quality.query,
        "op4_product_quantisation": embedding.query,
        "op5_scaled_sketch": sketch.query,
        "op6_secret_scan": secrets.query,
        "op7_piece_lattice": pieces.query,
        "op8_best_fit_packing": packing.query,
        "op9_surrogates": pii.query,
        "op10_min_cut_html": html_text.query,
    }


def oracle_sql() -> dict:
    return {}
