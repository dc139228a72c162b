"""Registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import alignment, audio, castore, divergence, graph_ann, langid, mixing, packing, quality, sharding, simhash, winnowing, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_char_ftrl": langid.op1_char_ftrl,
        "op2_virtual_slots": sharding.op2_virtual_slots,
        "op3_entropy_balancing": mixing.op3_entropy_balancing,
        "op4_longest_match": wordpiece.op4_longest_match,
        "op5_word_ftrl": quality.op5_word_ftrl,
        "op6_chroma_prints": audio.op6_chroma_prints,
        "op7_content_store": castore.op7_content_store,
        "op8_column_generation": packing.op8_column_generation,
        "op9_tiled_simhash": simhash.op9_tiled_simhash,
        "op10_pruned_graph": graph_ann.op10_pruned_graph,
        "op11_radix_audit": divergence.op11_radix_audit,
        "op12_byte_labels": alignment.op12_byte_labels,
        "op13_winnowing": winnowing.op13_winnowing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_radix_audit": divergence.SQL, "op13_winnowing": winnowing.SQL}
