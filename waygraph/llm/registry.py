"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from waygraph.llm import conversations, exact_dedup, importance, media_columns, mixing, near_dedup, packing, quality, sharding, simhash, token_counts, toxicity, warc_archive


def queries():
    """Query name -> function of (spark, sf_dir)."""
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": token_counts.query,
        "op2_sharding": sharding.query,
        "op3_near_dedup": near_dedup.query,
        "op4_toxicity": toxicity.query,
        "op5_media_columns": media_columns.query,
        "op6_quality": quality.query,
        "op7_warc_archive": warc_archive.query,
        "op8_mixing": mixing.query,
        "op9_packing": packing.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_conversation_repair": conversations.query,
        "op12_simhash": simhash.query,
        "op13_importance": importance.query,
    }


def oracle_sql():
    """DuckDB SQL of the queries that SQL can express."""
    return {"op10_exact_dedup": exact_dedup.SQL}
